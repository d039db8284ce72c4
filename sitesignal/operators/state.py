"""The current state of each case, its history, and the log of what was pulled."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns whose changes are kept over time.
HISTORY = (
    "asn", "asof", "status_code", "date_completed", "expiration_date", "date_built", "agl_structure_height",
    "agl_structure_height_det", "amsl_overall_height_proposed", "amsl_overall_height_det",
)
WINDOW_KEY = ("case_type", "year", "region", "start", "end")


def seen(batch: DataFrame, asof: Column) -> DataFrame:
    return batch.withColumns({"first_seen_asof": asof, "last_seen_asof": asof})


def upsert(current: DataFrame | None, batch: DataFrame, key: str = "asn", order: str = "batch_seq") -> DataFrame:
    """One row for each key: the one last seen, with the day it was first seen.

    batch: rows with first_seen_asof, last_seen_asof and `order`, which decides between rows of one day. An older
    snapshot that comes late changes first_seen_asof at most, so the order in which snapshots arrive doesn't matter.
    Columns that one side lacks are null there.
    """
    merged = batch if current is None else current.unionByName(batch, allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.desc("last_seen_asof"), F.desc_nulls_last(order))
    merged = merged.withColumns({"first_seen_asof": F.min("first_seen_asof").over(Window.partitionBy(key)), "__rn": F.row_number().over(latest)})
    return merged.where("__rn = 1").drop("__rn")


def history(current: DataFrame | None, batch: DataFrame, columns: tuple[str, ...] = HISTORY, key: str = "asn", order: str = "batch_seq") -> DataFrame:
    """One row for each key and day: the last of that day. batch has `order` as well, which is kept."""
    rows = batch.select(*columns, order)
    merged = rows if current is None else current.unionByName(rows, allowMissingColumns=True)
    last = Window.partitionBy(key, "asof").orderBy(F.desc_nulls_last(order))
    return merged.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def pending(windows: DataFrame, done: DataFrame) -> DataFrame:
    """The windows that are not in the log."""
    return windows.join(done.select(*WINDOW_KEY), list(WINDOW_KEY), "left_anti")


class Store:
    """Tables in one folder, as immutable Parquet parts and numbered manifests that say which parts make up a table.

    The manifest with the highest number is the table. A writer adds parts, claims the next number (which fails if another
    writer has it) and gives the manifest its name by one rename; nothing that a reader may hold is deleted or changed, so
    a crash at any point leaves the table as it was. Only the parts that a batch touches are written anew. The folder may
    be in any file system that Spark reads.
    """

    #: Parts of the table of cases.
    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def sequence(self, name: str) -> int:
        """The highest number that a writer of the table has claimed; 0 without any."""
        return max((int(n.split(".")[0]) for n in self._names(f"{self.root}/{name}/_manifests")), default=0)

    def manifest(self, name: str) -> dict | None:
        """parts (paths by part) and schema of the table's current version."""
        found = [n for n in self._names(f"{self.root}/{name}/_manifests") if n.endswith(".json")]
        if not found:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{name}/_manifests/{found[-1]}", wholetext=True).first()[0])

    def _put(self, path: str, text: str, overwrite: bool) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, name: str, parts: dict[str, str], schema: StructType) -> None:
        stem = f"{self.root}/{name}/_manifests/{self.sequence(name) + 1:012d}"
        self._put(f"{stem}.claim", "", False)
        self._put(f"{stem}.new", json.dumps({"parts": parts, "schema": schema.jsonValue()}), True)
        fs, new = self._fs(f"{stem}.new")
        if not fs.rename(new, self._fs(f"{stem}.json")[1]):
            raise OSError(f"could not publish {name}")

    def read(self, name: str, only: list[str] | None = None) -> DataFrame | None:
        """The table, or some of its parts; None if it has never been written."""
        found = self.manifest(name)
        if found is None:
            return None
        schema = StructType.fromJson(found["schema"])
        paths = sorted({p for k, p in found["parts"].items() if only is None or k in only})
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in paths])

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Replaces the whole table."""
        path = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{path}")
        self._publish(name, {"": path}, df.schema)
        return self.read(name)

    def merge(self, name: str, df: DataFrame, part: Column, keep: bool = True) -> None:
        """Replaces the parts that df has rows of (part: which one, as a string); keep: the table's other parts stay."""
        path = f"data/{uuid.uuid4().hex}"
        df.withColumn("part_", part).write.partitionBy("part_").parquet(f"{self.root}/{name}/{path}")
        new = {n.removeprefix("part_="): f"{path}/{n}" for n in self._names(f"{self.root}/{name}/{path}") if n.startswith("part_=")}
        old = (self.manifest(name) if keep else None) or {"parts": {}, "schema": StructType([]).jsonValue()}
        fields = {f.name: f for f in [*StructType.fromJson(old["schema"]).fields, *df.schema.fields]}
        self._publish(name, old["parts"] | new, StructType(list(fields.values())))

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Removes manifests but the last `keep` ones, and parts that none of these lists."""
        base = f"{self.root}/{name}"
        manifests = [n for n in self._names(f"{base}/_manifests") if n.endswith(".json")]
        used = {p.split("/")[1] for n in manifests[-keep:] for p in json.loads(self.spark.read.text(f"{base}/_manifests/{n}", wholetext=True).first()[0])["parts"].values()}
        old = [f"{base}/_manifests/{n}" for m in manifests[:-keep] for n in (m, m.replace(".json", ".claim"))]
        for path in [*old, *[f"{base}/data/{d}" for d in self._names(f"{base}/data") if d not in used]]:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def views(self, names: dict[str, str]) -> None:
        """Temp views by name for the tables that exist."""
        for view, name in names.items():
            df = self.read(name)
            if df is not None:
                df.createOrReplaceTempView(view)

    def stage(self, snapshots: DataFrame) -> None:
        """Adds snapshots (cases with asof and batch_seq) as a part that the next compaction folds in."""
        self.merge("staged", snapshots, F.lit(uuid.uuid4().hex))

    def compact(self) -> None:
        """Folds all staged parts in one pass. One that is folded twice, after a crash before the last step, changes nothing."""
        found = self.manifest("staged")
        if found is None or not found["parts"]:
            return
        self.fold(self.read("staged"))
        now = self.manifest("staged")
        self._publish("staged", {k: p for k, p in now["parts"].items() if k not in found["parts"]}, StructType.fromJson(now["schema"]))
        for name in ("staged", "cases", "case_history"):
            self.vacuum(name)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("asn"), F.lit(self.BUCKETS)).cast("string")

    def fold(self, snapshots: DataFrame) -> None:
        """Folds snapshots (cases with asof and batch_seq) into cases and case_history: the days and buckets they touch."""
        day = F.coalesce(F.col("asof").cast("string"), F.lit("none"))
        days = [r[0] for r in snapshots.select(day).distinct().collect()]  # as many as days of pulling
        self.merge("case_history", history(self.read("case_history", days), snapshots), day)
        buckets = [r[0] for r in snapshots.select(self._bucket()).distinct().collect()]  # BUCKETS at most
        self.merge("cases", upsert(self.read("cases", buckets), seen(snapshots, F.col("asof")).drop("asof")), self._bucket())
        self.views({"cases": "cases", "case_history": "case_history"})

    def rebuild(self, snapshots: DataFrame) -> None:
        """Both tables anew from all snapshots (with asof and batch_seq): one pass, in whatever order they come. Readers see
        the old tables until the new ones are there."""
        self.merge("case_history", history(None, snapshots), F.coalesce(F.col("asof").cast("string"), F.lit("none")), keep=False)
        self.merge("cases", upsert(None, seen(snapshots, F.col("asof")).drop("asof")), self._bucket(), keep=False)
        self.views({"cases": "cases", "case_history": "case_history"})
