"""Exact dedup: a tree merge of sorted digest runs, with DataFrame operations only.

Every input partition yields a run of (64-bit digest, SHA-256, byte length) entries, each with the identifier that
stays and a count. In each round, `fan_in` neighbouring runs (a binomial tree whose fan-in is a power of two) merge
into one: entries meet by their 64-bit digest and are united only when verified, that is when SHA-256 and length agree
too. Every level keeps one entry for each text of a run, sorted, so what moves shrinks from round to round, and a text
that fills a third of the corpus is one entry for each run after the first map-side combine. Runs stay split by digest
within a round, so the last merge is as wide as the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import ascii_lower, join_hot, name_filter, passed, staged

#: Runs merged into one in each round.
FAN_IN = 16


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row, run, h, sha, n for each row: the only pass over the texts."""
    text = F.encode(ascii_lower(F.col(text_col)), "UTF-8")
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.xxhash64("t").alias("h"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.octet_length("t").cast("long").alias("n"),
    )


def _merge(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: fan_in runs become one; verified equal entries unite, the best entry stays.

    The best entry is a struct, which no hash aggregation holds: each run is sorted and its neighbours united where it
    lies, the runs are exchanged, sorted together, and neighbours united again (Sort and SortAggregate on either side).
    """
    bits = fan_in.bit_length() - 1
    return (
        runs.withColumn("run", F.shiftright("run", bits))
        .groupBy("run", "h", "sha", "n")
        .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        .sortWithinPartitions("run", "h")
    )


def tree_merge(entries: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """h, sha, n, best, size: one row for each text. entries: staged digests()."""
    assert fan_in >= 2 and fan_in & (fan_in - 1) == 0, "fan_in is a power of two"
    sign = F.lit(1) if keep == "smallest" else F.lit(-1)
    best = F.struct(F.col("id").isNull().alias("void"), (sign * F.col("id")).alias("order"), "row", "id")
    runs = entries.select("run", "h", "sha", "n", best.alias("best"), F.lit(1).cast("long").alias("size"))
    last = entries.agg(F.max("run")).first()[0] or 0
    while True:
        runs = _merge(runs, fan_in)
        last >>= fan_in.bit_length() - 1
        runs = staged(runs, "dedup-runs")
        if last == 0:
            return runs.drop("run")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = FAN_IN
) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are one
    group. keep: 'smallest' or 'largest' identifier stays. A null identifier loses to any other. Where rows repeat
    the identifier that stays, exactly one of them has kept = true. An empty table gives an empty result. Other columns
    of docs are never looked at, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    entries = staged(digests(docs, id_col, text_col), "dedup-digests")
    winners = tree_merge(entries, keep, fan_in)
    return join_hot(entries, winners, ["h", "sha", "n"], "size").select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Only rows whose digest is among those of dropped rows move; they are matched by identifier and digest. Rows that
    repeat both, which no column tells apart, need an extra pass that leaves one of them.
    """
    marked = staged(exact_dedup(docs, id_col, text_col, keep), "dedup-marked")
    sha = F.sha2(F.encode(ascii_lower(F.col(text_col)), "UTF-8"), 256)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), sha.alias("sha"))
    named = lambda df: df.select(F.col(id_col).alias("wid"), F.col("text_sha256").alias("wsha")).distinct()
    lost = staged(named(marked.where("NOT kept")), "dedup-lost")
    rows = passed(rows, "sha", name_filter(lost, "wsha"))
    asked = rows.where("passed")
    on = lambda names: asked["sha"].eqNullSafe(names["wsha"]) & asked["id"].eqNullSafe(names["wid"])
    kept = rows.where("NOT passed").unionByName(asked.join(lost, on(lost), "left_anti"))
    again = named(marked.where(F.col("keep_id").eqNullSafe(F.col(id_col)) & ~F.col("kept")))
    if again.limit(1).count():
        kept = kept.unionByName(asked.join(again, on(again), "left_semi").dropDuplicates(["sha", "id"]))
    return kept.select("doc.*")
