"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal import session

#: Bits (a power of two) of the filters by which rows that nothing happens to are told before they move.
FILTER = 24

#: Arrow batches of the steps that are staged.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of the routing table that is broadcast by join_hot; a fixed bound, whatever the input.
HOT_KEYS = 1024


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join on keys, where right has one row for each key and weight says how many rows of left have it.

    The HOT_KEYS heaviest keys go by a broadcast of that many rows at most. Every other key holds less than
    1 / HOT_KEYS of left, so the shuffled join that takes the rest has no hot key. Both inputs must be staged:
    each is read twice.
    """
    hot = F.broadcast(right.orderBy(F.desc(weight), *keys).limit(HOT_KEYS))
    quick = left.join(hot, keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right, keys, "inner")
    return quick.unionByName(rest)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back. Arrow batches are small while it is written, so that long texts
    don't pile up; the caller's settings are as before afterwards."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in SMALL}
    try:
        for name, value in SMALL.items():
            conf.set(name, value)
        return session.staged(df, tag)
    finally:
        for name, value in before.items():
            conf.set(name, value)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about `size` bytes and at most `rows` rows, whatever the session's own batches are."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def name_filter(names: DataFrame, column: str) -> DataFrame:
    """A bit for each name of a column, in words of 64: at most 2^(FILTER - 6) rows, however many names. Staged."""
    at = names.select(F.pmod(F.xxhash64(column), F.lit(1 << FILTER)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63L AS int))").alias("bit"))
    return staged(words.groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")


def passed(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """rows with passed: false only for those whose name is not in the filter (words, which is broadcast).

    So whole texts need not move where only few of them are asked for: an exact join follows on those that pass. With
    more names than bits more pass, and the result is the same.
    """
    rows = rows.withColumn("at_", F.pmod(F.xxhash64(column), F.lit(1 << FILTER))).withColumn("word", F.shiftright("at_", 6))
    met = rows.join(F.broadcast(words), "word", "left")
    return met.withColumn("passed", F.expr("coalesce(bits & shiftleft(1L, cast(at_ & 63L AS int)) <> 0, false)")).drop("at_", "word", "bits")


def row_key(id_col: str, text_col: str) -> Column:
    """A name made of identifier and whole text; nulls count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hex(F.xxhash64(text)))
