"""Case lists as a Spark data source: one partition for each window, read from anything that serves windows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitesignal.sources.windows import Window


class WindowPartition(InputPartition):
    def __init__(self, window: Window):
        self.window = window


class CaseListReader(DataSourceReader):
    """Options: root, a folder of answers in the landing layout, and windows, a JSON list of window keys."""

    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.windows = [Window(t, r, date.fromisoformat(a), date.fromisoformat(b), asn_year=y) for t, y, r, a, b in json.loads(options["windows"])]

    def partitions(self) -> list[WindowPartition]:
        return [WindowPartition(w) for w in self.windows]

    def read(self, partition: WindowPartition) -> Iterator[tuple]:
        import gzip
        from pathlib import Path

        w = partition.window
        stem = f"{w.start}_{w.end}" + (f"_asn{w.year}" if w.year != w.start.year else "")
        for path in sorted(Path(self.root).glob(f"raw/asof=*/{w.case_type}/{w.region or 'ALL'}/{stem}*.xml.gz")):
            yield (*w.key, path.parts[-4].removeprefix("asof="), gzip.decompress(path.read_bytes()))


class CaseListSource(DataSource):
    """spark.dataSource.register(CaseListSource); spark.read.format("case_lists").option(...).load()"""

    @classmethod
    def name(cls) -> str:
        return "case_lists"

    def schema(self) -> str:
        return "case_type string, year int, region string, start date, end date, asof string, xml binary"

    def reader(self, schema) -> CaseListReader:
        return CaseListReader(self.options)
