"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are sorted by descending length and cut into blocks. The longest vectors answer every query first, which gives
each query a threshold: its k-th best score so far. By Cauchy-Schwarz a block whose longest vector is too short for a
query can't reach the threshold, so the query visits a prefix of the blocks only. Within a block, vectors and queries
are rotated by the right singular vectors of the whole table (from its Gram matrix), which puts most of a product into
the first coordinates; the partial sum over those plus the product of the residual lengths bounds the score, and only
vectors whose bound reaches the threshold are scored, in exact integer arithmetic.

Queries and blocks meet in cells of at most QUERIES queries and one block, so no task holds more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.common import staged

#: Vectors in a block, at least; more where there would be over BLOCKS blocks, since the blocks' lengths are broadcast.
BLOCK = 2048
BLOCKS = 65536
#: Vectors that answer every query first: the longest ones. They are broadcast.
FIRST = 8192
#: Queries in a cell.
QUERIES = 2048
#: Rotated coordinates of the partial sums.
HEAD = 16
#: Below this, products of integers are exact in doubles.
EXACT = 2.0**53


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """row, id, norm, v: floor(scale * x) as packed doubles, for the vectors that take part."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.floor(scale * np.array(x, dtype=np.float64)) for x in batch.column(1).to_pylist()]
            norm = [float(np.sqrt(np.square(x).sum())) for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm, pa.float64()), pa.array([x.tobytes() for x in out], pa.binary())],
                names=["id", "norm", "v"],
            )

    x = F.col(vec_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    valid = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(F.forall(x, finite))
    return valid.select(F.col(id_col).alias("id"), x.cast("array<double>")).mapInArrow(
        run, f"id {id_type}, norm double, v binary"
    )


def _unpack(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of dims doubles; shorter vectors are padded with zeros."""
    out = np.zeros((len(column), dims))
    for k, v in enumerate(column.to_pylist()):
        x = np.frombuffer(v, dtype=np.float64)
        out[k, : len(x)] = x
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the whole table, strongest first: dims x dims, from a Gram matrix summed in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dims, dims))
        for batch in batches:
            x = _unpack(batch.column(0), dims)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), *[pa.array(gram[:, j]) for j in range(dims)]],
            names=["i", *[f"g{j}" for j in range(dims)]],
        )

    schema = "i int, " + ", ".join(f"g{j} double" for j in range(dims))
    rows = vectors.select("v").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(dims)])
    gram = np.zeros((dims, dims))
    for r in rows.collect():  # dims rows, whatever the table
        gram[r["i"]] = [r[f"g{j}"] for j in range(dims)]
    gram = np.nan_to_num(gram / max(1e-300, np.abs(gram).max()))
    return np.linalg.eigh(gram)[1][:, ::-1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _search(queries: dict, block: dict, turn: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query row, id, score) of what a block offers to queries: dicts of row, id, norm, v, floor and floor_id (threshold)."""
    out_q, out_id, out_s = [], [], []
    order = np.argsort(-block["norm"], kind="stable")
    c, ids, norm = block["v"][order], block["id"][order], block["norm"][order]
    exact = float(np.abs(c).max(initial=0)) * float(np.abs(queries["v"]).max(initial=0)) * max(1, c.shape[1]) < EXACT
    head = min(HEAD, c.shape[1])
    cr, qr = c @ turn[:, :head], queries["v"] @ turn[:, :head]
    rest = lambda n, r: np.sqrt(np.maximum(0, n * n - np.square(r).sum(axis=1)))
    c_rest, q_rest = rest(norm, cr), rest(queries["norm"], qr)
    for lo in range(0, len(queries["row"]), 256):
        part = slice(lo, lo + 256)
        floor, qn = queries["floor"][part], queries["norm"][part]
        slack = 1e-9 * (qn * (norm[0] if len(norm) else 0) + 1)
        # lengths alone: each query takes a prefix of the block
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(qn > 0, (floor - slack) / qn, np.where(floor <= slack, -np.inf, np.inf))
        prefix = np.searchsorted(-norm, -reach, side="right")
        most = int(prefix.max(initial=0))
        if not most:
            continue
        bound = qr[part] @ cr[:most].T + np.outer(q_rest[part], c_rest[:most]) + slack[:, None]
        alive = bound >= floor[:, None]
        alive &= np.arange(most) < prefix[:, None]
        alive &= ids[:most] != queries["id"][part][:, None]
        some = np.flatnonzero(alive.any(axis=0))
        if exact:
            scores = queries["v"][part] @ c[some].T
        else:
            scores = queries["v"][part].astype(object) @ c[some].astype(object).T
            limit = (1 << 63) - 1
            scores = np.vectorize(lambda s: max(-limit, min(limit, int(s))), otypes=[object])(scores) if scores.size else scores
        # the threshold is a place in the ranking: of equal scores only smaller identifiers come before it
        tied = (scores == floor[:, None]) & (ids[some] <= queries["floor_id"][part][:, None])
        alive = alive[:, some] & ((scores > floor[:, None]) | tied)
        for r in np.flatnonzero(alive.any(axis=1)):
            at = np.flatnonzero(alive[r])
            if len(at) > k:
                s = scores[r, at].astype(np.float64) if exact else scores[r, at]
                at = at[_best(s, ids[some[at]], k)]
            out_q += [queries["row"][lo + r]] * len(at)
            out_id += ids[some[at]].tolist()
            out_s += [int(s) for s in scores[r, at]]
    return out_q, out_id, out_s


def _side(t: pa.Table, dims: int) -> dict:
    """The arrays of a cell's queries or vectors."""
    t = t.combine_chunks()
    v = _unpack(t.column("v").combine_chunks() if t.num_rows else pa.array([], pa.binary()), dims)
    return {n: t.column(n).to_numpy() for n in ("row", "id", "norm", "floor", "floor_id")} | {"v": v}


def top_k(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows but the query's own, by integer inner product of
    floor(scale * x), ties to the smaller identifier.

    is_query makes a condition of the identifier. Vectors that are null, hold a null or non-finite component, or have a null
    identifier take no part, as queries neither. Vectors shorter than the longest are padded with zeros; an empty one
    scores 0 with all. A row with the query's own identifier is not its candidate, repeats included. Fewer than k
    candidates: all are returned. Query rows that repeat an identifier are one query, that of the vector whose packed bytes
    come first; candidates that repeat it are ranked next to each other. An empty table gives an empty result. Other columns are not read. Scores beyond 64 bits saturate.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    packed = staged(quantised(vectors, id_col, vec_col, scale), "topk-vectors")
    total, widest = packed.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    dims = (widest or 0) // 8
    block_size = max(BLOCK, -(-total // BLOCKS))
    turn = rotation(packed, dims) if dims else np.zeros((0, 0))

    blocks = -(-total // block_size) or 1
    by_length = packed.repartitionByRange(blocks, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    by_length = staged(by_length.withColumn("block", F.spark_partition_id()), "topk-blocks")
    lengths = by_length.groupBy("block").agg(F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).collect()  # BLOCKS rows at most
    lengths = sorted((r["block"], r["norm"]) for r in lengths)

    queries = packed.where(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("q")).select("id", "q.v", "q.norm")
    queries = queries.withColumn("row", F.monotonically_increasing_id())
    longest = by_length.select("id", "norm", "v").orderBy(F.desc("norm"), "id").limit(FIRST)
    head = spark.sparkContext.broadcast([tuple(r) for r in longest.collect()])  # FIRST vectors at most
    turned = spark.sparkContext.broadcast(turn)
    steps = spark.sparkContext.broadcast((np.array([b for b, _ in lengths], np.int32), np.array([-x for _, x in lengths])))  # BLOCKS at most

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = head.value
        block = {
            "id": np.array([r[0] for r in rows]),
            "norm": np.array([r[1] for r in rows], dtype=np.float64),
            "v": _unpack(pa.array([bytes(r[2]) for r in rows], pa.binary()), dims),
        }
        for batch in batches:
            side = {"row": np.arange(batch.num_rows), "id": batch.column(0).to_numpy(), "norm": batch.column(1).to_numpy(), "v": _unpack(batch.column(2), dims), "floor": np.full(batch.num_rows, -np.inf), "floor_id": batch.column(0).to_numpy()}
            q, i, s = _search(side, block, turned.value, k)
            found: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for row, c, x in zip(q, i, s, strict=True):
                found[row].append((x, -c))
            last = [min(x) if len(x) == k else (-np.inf, 0) for x in found]
            floors = [pa.array([float(x) for x, _ in last], pa.float64()), pa.array([-c for _, c in last], batch.schema.field("id").type)]
            # a query of length n visits the blocks whose longest vector is floor / n at least; the blocks come by length
            floor, norm = floors[0].to_numpy(), side["norm"]
            reach = np.where((norm > 0) & np.isfinite(floor), floor / np.where(norm > 0, norm, 1) * (1 - np.sign(floor) * 1e-9), -np.inf)
            upto = np.searchsorted(steps.value[1], -reach, side="right")
            visit = pa.array([steps.value[0][:m].tolist() for m in upto.tolist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *floors, visit], names=["id", "norm", "v", "row", "floor", "floor_id", "visit"])

    schema = f"id {id_type}, norm double, v binary, row long, floor double, floor_id {id_type}, visit array<int>"
    queries = staged(queries.select("id", "norm", "v", "row").mapInArrow(start, schema), "topk-queries")

    groups = max(1, -(-queries.count() // QUERIES))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    spread = queries.withColumn("cell", group).withColumn("block", F.explode("visit"))
    asked = spread.select("block", "cell", F.lit(1).alias("side"), "row", "id", "norm", "v", "floor", "floor_id")
    # only the pairs of a block and a group of queries that are visited; a block has about block_size vectors
    pairs = staged(spread.select("block", "cell").distinct(), "topk-pairs")
    offered = by_length.join(pairs, "block")
    offered = offered.select("block", "cell", F.lit(0).alias("side"), F.lit(0).cast("long").alias("row"), "id", "norm", "v", F.lit(0.0).alias("floor"), F.col("id").alias("floor_id"))

    def cell(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        q, i, s = _search(_side(t.filter(pa.array(side == 1)), dims), _side(t.filter(pa.array(side == 0)), dims), turned.value, k)
        return pa.table({"row": pa.array(q, pa.int64()), "id": pa.array(i, t.schema.field("id").type), "score": pa.array(s, pa.int64())})

    both = offered.unionByName(asked)
    found = both.groupBy("block", "cell").applyInArrow(cell, f"row long, id {id_type}, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select("row", F.col("id").alias("query_id"))
    return ranked.join(names, "row").select("query_id", "rank", F.col("id").alias("vec_id"), "score")

