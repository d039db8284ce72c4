"""SimHash near-dedup: 64-bit fingerprints, linked through BK-trees, grouped into connected components.

Fingerprints that occur more than once are one node. A fingerprint is cut into BLOCKS blocks of bits. Two that differ
in at most `radius` bits agree on BLOCKS - radius whole blocks at least, so every choice of that many blocks gives a
table of shards: the nodes that agree on the chosen blocks. Each shard has a BK-tree, whose children are keyed by the
integer Hamming distance to the parent, and its nodes are looked up in it, following only edges within the radius of
their distance. A shard of over SHARD nodes is cut into parts by hash; each part's tree is sent to every other part, so
no task holds more than two parts, and all links are found.

From each shard come only the links that connect it (one less than its nodes at most), not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import join_hot, name_filter, passed, pieces, row_key, staged
from sitesignal.llm.components import components

#: Nodes in one BK-tree.
SHARD = 4096
#: Pairs (query, node) looked at together.
FRONTIER = 1 << 18
#: Common shingles that come last in the order of shingles.
LATE = 4096
#: Parity bits of a text's shingles.
BITS = 2048
#: Rows of cells taken together, and pairs looked at together.
CELLS = 1 << 16
#: Texts of one shingle beyond which they are parted.
CROWD = 1 << 15


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 if it has no words. words = 0: of its distinct words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z only, and white space is 20 and 09-0D
    if not parts:
        return 0
    hashes = [xxh64_intdigest(s, seed) for s in (set(parts) if words == 0 else shingles(parts, words))]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the 64-bit hashes; 0 without any."""
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 32768):
        bits = np.unpackbits(hashes[lo : lo + 32768].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def shingles(parts: list[bytes], words: int) -> list[bytes]:
    """All runs of `words` words, joined by spaces; the whole sequence if it is shorter."""
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [joined]
    ends = np.cumsum([len(p) + 1 for p in parts])
    stops = (ends[words - 1 :] - 1).tolist()
    starts = [0, *ends[: len(parts) - words].tolist()]
    return [joined[i:j] for i, j in zip(starts, stops, strict=True)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """id, fp for each row of docs; fp holds the 64 bits as a signed long. More seeds: fp, fp1, ..."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps = [np.array([fingerprint(t, words, s) for t in texts], dtype=np.uint64) for s in seeds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in fps]], names=["id", *names])

    names = ["fp", *[f"fp{k}" for k in range(1, len(seeds))]]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, " + ", ".join(f"{n} long" for n in names)
    )


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits that each table's shards agree on, as signed longs."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """BK-trees of many shards, built and searched level by level with whole-array steps."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        """group: sorted; value: uint64, none twice in a group."""
        n = len(value)
        self.value = value
        first = np.ones(n, dtype=bool)
        first[1:] = group[1:] != group[:-1]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, active = self.root.copy(), np.flatnonzero(~first)
        while active.size:
            d = np.bitwise_count(value[active] ^ value[at[active]]).astype(np.int64)
            key = at[active] * 65 + d
            order = np.argsort(key, kind="stable")
            key, rows = key[order], active[order]
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            child = rows[head]
            parent[child], edge[child] = key[head] // 65, key[head] % 65
            at[rows] = child[np.cumsum(head) - 1]
            active = rows[~head]
        inner = np.flatnonzero(parent >= 0)
        key = parent[inner] * 65 + edge[inner]
        order = np.argsort(key, kind="stable")
        self.child, self.key = inner[order], key[order]

    def search(self, query: np.ndarray, value: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) arrays of all nodes within the radius; query: any labels; value, root: of each query."""
        stack = [(query, value, root)]
        while stack:
            q, v, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[half:], v[half:], node[half:]), (q[:half], v[:half], node[:half])]
                continue
            d = np.bitwise_count(v ^ self.value[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            count = hi - lo
            if total := int(count.sum()):
                ends = np.cumsum(count)
                slot = np.repeat(lo - ends + count, count) + np.arange(total)
                stack.append((np.repeat(q, count), np.repeat(v, count), self.child[slot]))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i]; label[i] <= i points towards the class's smallest member."""
    while a.size:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(hop := label[label], label):
            label[:] = hop
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def _shortest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of links that connect all that the links (a, b) connect, short ones first: a minimum spanning forest."""
    label, out = np.arange(n), []
    for level in np.unique(d).tolist():
        at = np.flatnonzero(d == level)
        while True:
            la, lb = label[a[at]], label[b[at]]
            apart = la != lb
            at, high, low = at[apart], np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]
            if not at.size:
                break
            high, pick = np.unique(high, return_index=True)  # each class joins a smaller one by one link
            out.append(at[pick])
            hook = np.arange(n)
            hook[high] = low[pick]
            while not np.array_equal(hop := hook[hook], hook):
                hook = hop
            label = hook[label]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _links(cell: np.ndarray, own: np.ndarray, value: np.ndarray, radius: int, real: bool) -> tuple[np.ndarray, np.ndarray]:
    """The links that connect each cell: cell sorted; own: whether the row belongs in the cell's tree.

    real: each link is between two nodes within the radius, and short ones come first; else from nodes to their
    class's smallest."""
    n = len(value)
    label = np.arange(n)
    tree = np.flatnonzero(own)
    forest = Forest(cell[tree], value[tree])
    queries = np.flatnonzero(~own)
    # rows that are not in a tree look it up; a cell without such rows is looked up by its own rows
    alone = ~np.isin(cell, cell[queries])
    rows = np.concatenate([queries, np.flatnonzero(own & alone)])
    where = np.searchsorted(cell[tree], cell[rows])
    has = (where < len(tree)) & (cell[tree[np.minimum(where, len(tree) - 1)]] == cell[rows]) if len(tree) else np.zeros(len(rows), bool)
    rows, root = rows[has], where[has]
    if real:
        links = np.zeros((3, 0), dtype=np.int64)
        for q, node in forest.search(rows, value[rows], root, radius):
            node = tree[node]
            distance = np.bitwise_count(value[q] ^ value[node]).astype(np.int64)
            links = np.concatenate([links, np.stack([q, node, distance])[:, q != node]], axis=1)
            if links.shape[1] > 2 * FRONTIER:
                links = links[:, _shortest(n, *links)]
        links = links[:, _shortest(n, *links)]
        return value[links[0]], value[links[1]]
    for q, node in forest.search(rows, value[rows], root, radius):
        _unite(label, q, tree[node])
    moved = np.flatnonzero(label != np.arange(n))
    return value[moved], value[label[moved]]


def _search_cells(radius: int, real: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, rows
            t, key, x, y, part, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            end = len(t) if last else int(np.flatnonzero(new)[-1])
            held, rows = [tuple(c[end:] for c in (t, key, x, y, part, fp))], len(t) - end
            cell = np.cumsum(new[:end]) - 1
            many = np.bincount(cell, minlength=1)[cell] > 1 if end else np.zeros(0, bool)
            if not many.any():
                return None
            own = (part == x)[:end][many]
            a, b = _links(cell[many], own, fp[:end][many].view(np.uint64), radius, real)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= 1 << 17 and (out := flush(False)) is not None:
                yield out
        if rows and (out := flush(True)) is not None:
            yield out

    return run


def near_links(nodes: DataFrame, radius: int = 4, blocks: int = 6, real: bool = False) -> DataFrame:
    """a, b: links that connect all nodes (staged column fp, distinct longs) within the radius of each other.

    real: every link is itself within the radius, short ones preferred."""
    masks = F.array(*[F.lit(m) for m in block_masks(radius, blocks)])
    entries = nodes.select("fp", F.posexplode(masks).alias("t", "mask"))
    entries = entries.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    large = staged(entries.groupBy("t", "key").count().where(F.col("count") > SHARD), "shards-large")
    if large.limit(1).count():
        parts = large.select("t", "key", F.ceil(F.col("count") / SHARD).cast("int").alias("parts"))
        entries = entries.join(parts, ["t", "key"], "left")
        part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
        entries = entries.select("t", "key", "fp", part.alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"))
        entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        entries = entries.select("t", "key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "fp")
    else:
        entries = entries.select("t", "key", *[F.lit(0).alias(c) for c in ("x", "y", "part")], "fp")
    cells = entries.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")
    return cells.select("t", "key", "x", "y", "part", "fp").mapInArrow(_search_cells(radius, real), "a long, b long")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int = 6
) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z only), cut at ASCII white space and hashed by `words`-word shingles with XXH64, seed 42;
    a bit is 1 if set in over half of the shingles' hashes. Fewer words than that: the whole sequence is one shingle.
    Null, empty and blank texts have fingerprint zero and link like any other. Fingerprints link at `radius` or fewer
    differing bits; component_id is the smallest identifier reachable. Null identifiers lose to any other; rows that
    repeat get the same component. An empty table gives an empty result. Other columns are not read.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")), "nodes")
    labels = components(near_links(nodes.select("fp"), radius, blocks))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = staged(labelled.select("fp", "first", "size", F.coalesce("label", "fp").alias("label")), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    smallest = staged(smallest, "smallest")
    known = staged(join_hot(labelled, smallest, ["label"], "weight").select("fp", "component_id", "size"), "known")
    return join_hot(prints, known, ["fp"], "size").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's `words`-word shingles; empty if it has no words."""
    from xxhash import xxh64_intdigest

    for t in texts:
        parts = t.encode("utf-8").lower().split()
        yield np.unique(np.array([xxh64_intdigest(s, 42) for s in shingles(parts, words)] if parts else [], dtype=np.uint64))


def _prefix(hashes: np.ndarray, late: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes, those in late after all others: two sets of the similarity or more share one of these.

    They share similarity * n of either's n hashes at least, so not all of them come after the prefix. An empty set has
    the hash 0, by which it meets other empty sets.
    """
    n = len(hashes)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    least = int(np.ceil(similarity * n - 1e-9))
    if len(late):
        last = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[: n - least + 1]


def _parity(hashes: np.ndarray) -> bytes:
    """BITS bits: whether an odd number of hashes falls on each. Two sets differ in as many hashes as bits at least."""
    return np.packbits(np.bincount((hashes % BITS).astype(np.int64), minlength=BITS) & 1).tobytes()


def _differ(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many hashes may be in one of two sets only, if they have n hashes between them and the similarity."""
    return (1 - similarity) / (1 + similarity) * n + 1e-6


def _may_match(na: np.ndarray, at: np.ndarray, nb: np.ndarray, bt: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets whose first common hash is at places at and bt can reach the similarity, by their sizes."""
    return na + nb - 2 * np.minimum(na - at, nb - bt) <= _differ(na + nb, similarity)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables made of whole cells (rows of one value of the first column; they come together)."""
    held, rows = [], 0

    def cut(last: bool) -> pa.Table:
        nonlocal held, rows
        table = pa.Table.from_batches(held)
        cell = table.column(0).to_numpy()
        end = len(cell) if last else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
        held, rows = table.slice(end).to_batches(), len(cell) - end
        return table.slice(0, end)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CELLS and held[0].column(0)[0] != held[-1].column(0)[-1]:
                yield cut(False)
    if rows:
        yield cut(True)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those whose value an other row has as well; one row at a time is held back."""
    last, met = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        value = batch.column(0).to_numpy()
        same = value[1:] == value[:-1]
        keep = np.concatenate([[last is not None and met], same]) | np.concatenate([same, [False]])
        if keep[:-1].any():
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        last, met = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if last is not None and met:
        yield last


def _across(similarity: float):
    """All pairs of a cell's texts in different groups that may reach the similarity, but for those of one part where
    `inner` is false (they meet in another cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cell, nid, n, at, label, part, inner = (table.column(c).to_numpy() for c in ("cell", "nid", "n", "at", "label", "part", "inner"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            # by size within a cell: each text is held against the next one, then the one after that, and so on, as long
            # as sizes allow
            rows = np.lexsort((n, cell))
            first, ahead = np.arange(len(rows)), 0
            while len(first):
                ahead += 1
                first = first[first + ahead < len(rows)]
                x, y = rows[first], rows[first + ahead]
                near = (cell[x] == cell[y]) & (n[y] <= n[x] / similarity + 1e-6)
                first, x, y = first[near], x[near], y[near]
                ok = (label[x] != label[y]) & ((part[x] != part[y]) | inner[x]) & _may_match(n[y], at[y], n[x], at[x], similarity)
                x, y = x[ok], y[ok]
                for lo in range(0, len(x), CELLS):
                    u, v = x[lo : lo + CELLS], y[lo : lo + CELLS]
                    ok = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64) <= _differ(n[u] + n[v], similarity)
                    if ok.any():
                        u, v = nid[u[ok]], nid[v[ok]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return run


def _parted(texts: DataFrame) -> DataFrame:
    """texts (staged: token, nid, n, at, label) with cell, part and inner: a token of over CROWD texts is many cells.

    Texts of one group need not meet each other. So those of a token's largest group are parted, the others are parted,
    and each part meets the others' parts: a group that holds a third of all texts is sent once for each CROWD of others.
    """
    sizes = texts.groupBy("token", "label").count()
    crowded = sizes.groupBy("token").agg(F.sum("count").alias("all"), F.max(F.struct("count", "label")).alias("top")).where(F.col("all") > CROWD)
    crowded = staged(crowded, "crowded")
    one = F.lit(0).cast("int")
    plain = texts
    if few := crowded.limit(1).count():
        plain = texts.join(crowded.select("token"), "token", "left_anti")
    plain = plain.withColumns({"cell": F.col("token"), "part": one, "inner": F.lit(True)})
    if not few:
        return plain
    many = lambda c: F.greatest(F.lit(1), F.ceil(c / CROWD)).cast("int")
    crowded = crowded.select("token", F.col("top.label").alias("most"), many(F.col("top.count")).alias("p"), many(F.col("all") - F.col("top.count")).alias("q"))
    rows = texts.join(crowded, "token")
    hash_ = F.xxhash64("nid")
    own = F.when(F.col("label") == F.col("most"), F.pmod(hash_, "p")).otherwise(F.col("p") + F.pmod(hash_, "q")).cast("int")
    rows = rows.withColumn("part", own)
    others = F.sequence(F.when(F.col("part") < F.col("p"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)
    rows = rows.withColumn("other", F.explode(others))
    cell = F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other"))
    return plain.unionByName(rows.withColumns({"cell": cell, "inner": F.col("part") == F.col("other")}).drop("other", "most", "p", "q"))


def _alike(links: DataFrame, prints: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the staged links (a, b) whose texts are alike: by parity bits first, then on the whole texts."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("ta", "tb")]
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64) <= _differ(n, similarity)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [h.tobytes() for h in _sets(batch.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["nid", "hashes"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    ends = [prints.select(F.col("nid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"t{c}")) for c in "ab"]
    close = links.join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "ta", "tb")
    close = staged(close.mapInArrow(near, "a long, b long"), "close")
    asked = close.select(F.col("a").alias("nid")).unionByName(close.select(F.col("b").alias("nid"))).distinct()
    asked = asked.join(prints.select("nid", "key"), "nid")
    asked = staged(asked, "asked")
    wanted = passed(rows, "key", name_filter(asked, "key")).where("passed")
    wanted = wanted.join(asked.hint("shuffle_hash"), "key").select("nid", "text")
    hashes = staged(wanted.mapInArrow(sets, "nid long, hashes binary").dropDuplicates(["nid"]), "shingles")
    left, right = (hashes.select(F.col("nid").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    checked = close.join(left, "a").join(right, "b").select("a", "b", "ha", "hb")
    return staged(checked.mapInArrow(alike, "a long, b long"), "alike")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """key, id, first for each distinct row (id, text) of docs: first is the key of its group's smallest id.

    Texts are alike if the sets of their `words`-word shingles have a Jaccard similarity of `similarity` or more; groups
    are what chains of alike texts connect. Candidates come from the SimHash fingerprints of the sets, through BK-trees;
    each is checked on the whole texts. 64 bits lose pairs near the similarity, so what they leave apart is completed:
    shingles have one order, by hash, but LATE common ones (found in a sample, which decides the order only) come last;
    two alike texts share one among the first n - similarity * n + 1 of each (prefix filter), so cells of texts that
    share one hold all pairs. First groups that are next to each other in a cell are tried by one text of each until none
    unites; then all pairs of a cell that are still in different groups, but for those that sizes, places or parity bits
    rule out. Nothing is pruned unchecked, and texts of one group are not paired. key is made of id and text, so
    identifiers that repeat with other texts don't mix; null ids and texts count as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [_prefix(h, h[:0], similarity) for h in _sets(batch.column(0).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["token"])

    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(8)) == 0).select("text").mapInArrow(sample, "token long")
    common = some.groupBy("token").count().where("count >= 16").orderBy(F.desc("count"), "token").limit(LATE).collect()
    late = np.sort(np.array([r.token for r in common], dtype=np.int64).view(np.uint64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(2).to_pylist(), words))
            fps = np.array([majority(h) for h in sets], dtype=np.uint64).view(np.int64)
            columns = [pa.array([len(h) for h in sets], pa.int32()), pa.array([_parity(h) for h in sets], pa.binary()), pa.array(fps)]
            tokens = pa.array([_prefix(h, late, similarity).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, tokens], names=["key", "id", "n", "bits", "fp", "tokens"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t, np.int64) for t in batch.column(2).to_pylist()]
            if not found:
                continue
            count = np.array([len(t) for t in found])
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            columns = [np.concatenate(found), *[np.repeat(batch.column(k).to_numpy(), count) for k in (0, 1)], at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "nid", "n", "at"])

    prints = rows.mapInArrow(sketch, f"key string, id {id_type}, n int, bits binary, fp long, tokens binary")
    prints = staged(prints.withColumn("nid", F.monotonically_increasing_id()), "prints")
    once = staged(prints.groupBy("key", "id").agg(F.min("nid").alias("nid"), F.count(F.lit(1)).alias("size")), "once")
    if once.where("size > 1").limit(1).count():
        prints = staged(prints.join(once.select("nid"), "nid", "left_semi"), "prints")

    # links within the radius between fingerprints, and of one fingerprint's texts with the first of them
    nodes = staged(prints.groupBy("fp").agg(F.min("nid").alias("node"), F.count(F.lit(1)).alias("size")), "nodes")
    ends = [nodes.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}")) for c in "ab"]
    across = near_links(nodes.select("fp"), radius, real=True).join(ends[0], "a").join(ends[1], "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    within = join_hot(prints.select("fp", "nid"), nodes, ["fp"], "size").where("nid <> node").select(F.col("node").alias("a"), F.col("nid").alias("b"))
    links = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within).distinct()
    links = staged(links, "candidates")
    alike = _alike(links, prints, rows, words, similarity)

    cell = "token long, nid long, n int, at int"
    cells = prints.select("nid", "n", "tokens").mapInArrow(entries, cell).repartition("token").sortWithinPartitions("token")
    cells, one = staged(cells.mapInArrow(_repeated, cell), "cells"), True
    while True:
        labels = components(alike)
        apart = cells.join(labels.withColumnRenamed("node", "nid"), "nid", "left")
        apart = staged(apart.select("token", "nid", "n", "at", F.coalesce("label", "nid").alias("label")), "labelled")
        mixed = apart.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        apart = staged(apart.join(mixed, "token", "left_semi"), "mixed")
        cells = apart.drop("label")  # groups only grow, so a cell within one group stays so
        if one:
            apart = apart.groupBy("token", "label").agg(F.min(F.struct("nid", "n", "at")).alias("r")).select("token", "r.nid", "r.n", "r.at", "label")
            apart = staged(apart, "ones")
        met = _parted(apart).join(prints.select("nid", "bits"), "nid").repartition("cell").sortWithinPartitions("cell")
        more = met.select("cell", "nid", "n", "at", "label", "part", "inner", "bits").mapInArrow(_across(similarity), "a long, b long").distinct()
        more = staged(more.join(links, ["a", "b"], "left_anti"), "candidates")
        found = _alike(more, prints, rows, words, similarity)
        alike, links = alike.unionByName(found), links.unionByName(more)
        if not one:
            break
        one = found.limit(1).count() > 0
    labels = components(alike)
    grouped = prints.select("nid", "key", "id").join(labels.withColumnRenamed("node", "nid"), "nid", "left")
    grouped = staged(grouped.select("key", "id", F.coalesce("label", "nid").alias("label")), "grouped")
    best = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best")
    first = staged(grouped.groupBy("label").agg(best, F.count(F.lit(1)).alias("size")), "first")
    return join_hot(grouped, first, ["label"], "size").select("key", "id", F.col("best.key").alias("first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that are their group's first, with all their columns; of rows that repeat, one."""
    groups = staged(similar_groups(docs, id_col, text_col, words, similarity), "groups")
    names = groups.where("key <> first").select("key")
    keyed = passed(docs.select(F.struct("*").alias("doc"), row_key(id_col, text_col).alias("key")), "key", name_filter(names, "key"))
    kept = keyed.where("NOT passed").unionByName(keyed.where("passed").join(names, "key", "left_anti")).drop("passed")
    again = staged(docs.select(row_key(id_col, text_col).alias("key")).groupBy("key").count().where("count > 1").select("key"), "repeats")
    if again.limit(1).count():
        once = kept.join(again, "key", "left_semi").dropDuplicates(["key"])
        kept = kept.join(again, "key", "left_anti").unionByName(once)
    return kept.select("doc.*")
