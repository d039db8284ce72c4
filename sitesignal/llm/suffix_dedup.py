"""Suffix-array dedup: removes every byte that a `length`-byte string covers which also starts somewhere else.

Equal strings have equal content, so the smallest hash among their GRAM-byte grams is the same and stands at the same
place. That gram is the string's anchor. A text is cut into stretches of strings with one anchor; all stretches with
the same anchor gram form a collection, and only strings of one collection, at one distance from the anchor, can be
equal. Collections with one stretch are dropped before any text moves.

A collection is indexed column by column: its stretches are lined up at the anchor, and from the last column to the
first each round inserts one symbol of every stretch. The round updates the order of the suffixes that start at its
column (a stable sort of the order before by the new symbol, the step by which a collection's Burrows-Wheeler transform
grows) and the common prefixes of neighbours (the minimum of what lay between them, or nothing where the symbols
differ). A string occurs again exactly if its suffix shares `length` symbols with a neighbour in that order.
The collections come to a task as sorted files, one after the other; as many as fit CHUNK are indexed together with
whole-array steps, so memory is bounded by CHUNK and the largest collection.

Stretches that are equal as a whole (a passage that many texts share has many of those) are one entry of their
collection; they occur again by that alone, and only one of them is indexed. A common line makes a large collection of
entries that differ around it. Where one has over LARGE entries, its strings get another anchor, a longer gram, which
the line alone can't fill; equal strings still share it. The grams of the last step are whole strings, so that a
collection has one entry only. Texts that are equal as a whole are handled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import HOT_KEYS, join_hot, name_filter, passed, pieces, staged

#: Bytes of a gram: the shortest first, then those for the strings of large collections; None: whole strings.
GRAMS = (64, 256, 384, None)
#: Bytes whose anchors are found together; longer texts go in parts that overlap by a string.
PART = 1 << 20
#: Bytes of lined-up stretches that are indexed together.
CHUNK = 8 << 20
#: Entries from which a collection's strings get a longer anchor.
LARGE = 32768

_BITS = 22  # of a place within a part
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


class _Powers:
    """Powers of the hash's base and of its inverse, modulo 2^64."""

    made: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.made is None:
            up, down = (np.full(PART + 4096, x % (1 << 64), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            cls.made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.made


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram that starts at each place of data (at most PART + 4096 bytes)."""
    up, down = _Powers.get()
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For the string that starts at each place: where the gram of the smallest hash starts, the first if there are
    more; and the hashes by place."""
    width = length - gram + 1
    h = gram_hashes(data, gram)
    key = (h >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(h), dtype=np.uint64)
    # minimum over width places: of a block's tail and of the next one's head
    blocks = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & np.uint64((1 << _BITS) - 1)).astype(np.int64), h


def stretches(data: np.ndarray, ends: np.ndarray, length: int, large: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """The stretches of texts laid end to end: (start, left, n, v) arrays.

    A stretch has the n strings that start at start, start + 1, ...; its anchor is at start + left, and names the
    collection v. ends: where each text ends. large: for each step, the collections whose strings go on to the next.
    """
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return none
    n = len(data) - length + 1
    valid = np.ones(n, dtype=bool)  # strings must not cross the end of a text
    for end in ends.tolist():
        valid[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    where, h = anchors(data, length, GRAMS[0])
    anchor = where[at]
    v = h[anchor]
    for step, names in enumerate(large, 1):
        more = np.flatnonzero(np.isin(v, names))
        if len(more):
            where, h = anchors(data, length, GRAMS[step] or length)
            anchor[more] = where[at[more]]
            v[more] = h[anchor[more]] ^ np.uint64(step * int(_MIX) % (1 << 64))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start = at[first]
    return start, anchor[first] - start, np.diff(np.append(first, len(at))), v[first]


def _laid_out(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts, or parts of long ones, laid end to end up to PART bytes: (text number, offset in it), bytes, ends."""
    which, offset, parts, size = [], [], [], 0

    def done():
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        return which, offset, data, np.cumsum([len(p) for p in parts])

    for k, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - length + 1), PART - length):
            part = text[lo : lo + PART - 1]  # PART - length strings, none twice
            if size + len(part) > PART and parts:
                yield done()
                which, offset, parts, size = [], [], [], 0
            which.append(k)
            offset.append(lo)
            parts.append(part)
            size += len(part)
    if parts:
        yield done()


def text_stretches(texts: list[bytes], length: int, large: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, start in the text, left, n, v) arrays of all texts' stretches."""
    for which, offset, data, ends in _laid_out(texts, length):
        start, left, n, v = stretches(data, ends, length, large)
        part = np.searchsorted(ends, start, side="right")
        begin = ends - np.diff(np.concatenate([[0], ends]))
        yield np.array(which, np.int64)[part], start - begin[part] + np.array(offset, np.int64)[part], left, n, v


def repeated_strings(group: np.ndarray, left: np.ndarray, n: np.ndarray, text: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place) of all strings that occur again: place counts the strings of its stretch from 0.

    group: the collection of each stretch, sorted. text: the bytes of each, n + length - 1 of them.
    """
    m = len(group)
    before = int(left.max())
    width = before + int((n + length - 1 - left).max())
    zero = any(b"\0" in t for t in text)  # 0 stands for no symbol
    columns = np.zeros((m, width), dtype=np.uint16 if zero else np.uint8)
    first = before - left
    inside = np.zeros((m, width), dtype=bool)
    for k, t in enumerate(text):
        columns[k, first[k] : first[k] + len(t)] = np.frombuffer(t, dtype=np.uint8).astype(columns.dtype) + zero
        inside[k, first[k] : first[k] + len(t)] = True
    columns, inside = np.ascontiguousarray(columns.T), np.ascontiguousarray(inside.T)
    bucket = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    small = bucket.astype(np.uint16) if bucket[-1] < 1 << 16 else bucket
    order = np.arange(m)
    until = np.zeros(m + 1, dtype=np.int64)  # until[k]: the column where order[k] and order[k - 1] part
    found_row, found_at = [], []
    for x in range(width - 1, -1, -1):
        symbol = columns[x][order]
        step = np.argsort(symbol, kind="stable")
        step = step[np.argsort(small[order[step]], kind="stable")]
        moved = order[step]
        same = np.zeros(m + 1, dtype=bool)
        c, b, there = symbol[step], bucket[moved], inside[x][moved]
        same[1:m] = (c[1:] == c[:-1]) & (b[1:] == b[:-1]) & there[1:] & there[:-1]
        now = np.full(m + 1, x, dtype=np.int64)
        pair = np.flatnonzero(same)
        if len(pair):
            bounds = np.empty(2 * len(pair), dtype=np.int64)
            bounds[0::2], bounds[1::2] = step[pair - 1] + 1, step[pair] + 1
            # a suffix that begins here for either of two (one ends at this column) parts from the other right after it
            now[pair] = np.maximum(np.minimum.reduceat(until, bounds)[0::2], x + 1)
        order, until = moved, now
        again = until - x >= length
        if again.any():
            hit = again[:m] | again[1:]
            rows = order[hit]
            place = x - first[rows]
            ok = (place >= 0) & (place < n[rows])
            found_row.append(rows[ok].astype(np.int32))
            found_at.append(place[ok].astype(np.int16))
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_at)


def _spans(rows: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, from, to): strings that follow each other, as covered bytes."""
    if not len(rows):
        return rows, place, place
    order = np.lexsort((place, rows))
    rows, place = rows.astype(np.int64), place.astype(np.int64)
    rows, place = rows[order], place[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(rows)) - 1
    return rows[head], place[head], place[last] + length


def _find(length: int):
    """Reads stretches sorted by collection; gives (th, from, to) of bytes that are covered by repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def index(rows: list[tuple]) -> pa.RecordBatch | None:
            v = np.array([r[0] for r in rows], dtype=np.int64)
            new = np.concatenate([[True], v[1:] != v[:-1]])
            number = np.cumsum(new) - 1
            many = np.bincount(number)[number] > 1
            rows = [r for r, ok in zip(rows, many.tolist(), strict=True) if ok]
            if not rows:
                return None
            left, n = (np.array([r[c] for r in rows], dtype=np.int64) for c in (3, 4))
            hit, place = repeated_strings(number[many], left, n, [r[6] for r in rows], length)
            alone = np.array([r[5] for r in rows])[hit]  # the others are known to occur again
            hit, place = hit[alone], place[alone]
            k, lo, hi = _spans(hit, place, length)
            if not len(k):
                return None
            start = np.array([r[2] for r in rows], dtype=np.int64)[k]
            th = [rows[i][1] for i in k.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(th, pa.binary()), pa.array(start + lo), pa.array(start + hi)], names=["th", "lo", "hi"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= CHUNK and held and held[-1][0] != row[0]:
                    if (out := index(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += 2 * length
        if held and (out := index(held)) is not None:
            yield out

    return run


STRETCHES = "v long, th binary, start long, left short, n short, b long, c long"


def _anchors(length: int):
    """v, th, start, left, n, b, c for each stretch of each text; th: the first 16 bytes of its SHA-256; b and c: the first
    128 bits of the SHA-256 of all bytes of the stretch. A second column names collections, by step, whose strings go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None and len(t) >= length]
            large: tuple[np.ndarray, ...] = ()
            if batch.num_columns > 1:
                # each text lists the names it holds; that another one's are looked for as well does no harm
                named = {(r["step"], r["v"]) for names in batch.column(1).to_pylist() for r in names}
                large = tuple(np.array([v for s, v in named if s == step], dtype=np.int64).view(np.uint64) for step in range(1, len(GRAMS)))
            th = [hashlib.sha256(t).digest()[:16] for t in texts]
            for which, start, left, n, v in text_stretches(texts, length, large):
                ends = start + n + length - 1
                whole = [hashlib.sha256(texts[k][lo:hi]).digest()[:16] for k, lo, hi in zip(which.tolist(), start.tolist(), ends.tolist(), strict=True)]
                whole = np.frombuffer(b"".join(whole), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(v.view(np.int64)), pa.array([th[k] for k in which.tolist()], pa.binary()), pa.array(start.astype(np.int64)),
                        pa.array(left.astype(np.int16)), pa.array(n.astype(np.int16)), pa.array(whole[:, 0]), pa.array(whole[:, 1]),
                    ],
                    names=["v", "th", "start", "left", "n", "b", "c"],
                )

    return run


def _cut(length: int):
    """Reads texts with their shared stretches; gives the stretches' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "th", "start", "left", "n", "alone", "s"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows, size = [], 0
            for th, text, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for p in places:
                    start, n = p["start"], p["n"]
                    rows.append((p["v"], th, start, p["left"], n, p["alone"], text[start : start + n + length - 1]))
                    size += length
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


ENTRY = ["v", "left", "n", "b", "c"]


def collections(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Staged: all stretches, and their entries: ENTRY, rep (th and start of one), size, and others in the collection.

    While there are collections of over LARGE entries, the texts that they come from, and no others, get longer anchors
    for these; each text brings the names along that it needs, so how many there are does not matter.
    """
    found = staged(docs.select("bytes").mapInArrow(_anchors(length), STRETCHES).distinct(), "suffix-anchors")
    asked = None
    for step in range(1, len(GRAMS) + 1):
        entries = found.groupBy(*ENTRY).agg(F.min(F.struct("th", "start")).alias("rep"), F.count(F.lit(1)).alias("size"))
        entries = staged(entries, "suffix-entries")
        counts = staged(entries.groupBy("v").count().where("count > 1"), "suffix-collections")
        large = counts.where(F.col("count") > LARGE).select("v")
        if step == len(GRAMS) or not large.limit(1).count():
            break
        new = staged(found.join(large, "v", "left_semi").select("th", "v", F.lit(step).alias("step")).distinct(), "suffix-large")
        asked = new if asked is None else asked.unionByName(new)
        texts = asked.join(new.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.collect_set(F.struct("step", "v")).alias("names"))
        texts = staged(texts, "suffix-again")
        named = docs.select("bytes", F.substring(F.unhex(F.sha2("bytes", 256)), 1, 16).alias("th")).join(texts.hint("shuffle_hash"), "th")
        again = named.select("bytes", "names").mapInArrow(_anchors(length), STRETCHES).distinct()
        found = staged(found.join(texts.select("th"), "th", "left_anti").unionByName(again), "suffix-anchors")
    return found, entries.join(counts, "v", "left").withColumn("others", F.coalesce("count", F.lit(1)) - 1).drop("count")


def _take_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left of text, how many bytes went, and the maximal runs that went."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return b"".join(kept), sum(hi - lo for lo, hi in runs), [(lo, hi) for lo, hi in runs]


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For rows (id, bytes): a staged table of the texts (sha, n, owner: the smallest id, size: rows with this text), one of
    the rows (id, n, sha, size), one of the texts that lose bytes, once each (th, bytes, spans), and the filter of all texts
    that repeat or share anything."""
    rows = staged(docs.select("id", F.octet_length("bytes").cast("long").alias("n"), F.unhex(F.sha2("bytes", 256)).alias("sha")), "suffix-texts")
    texts = staged(rows.groupBy("sha").agg(F.min("id").alias("owner"), F.max("n").alias("n"), F.count(F.lit(1)).alias("size")), "suffix-distinct")
    found, entries = collections(docs, length)
    entries = staged(entries.where("size > 1 OR others > 0"), "suffix-repeated")
    # what is known by the entries alone, and what has to be indexed
    equal = join_hot(found, entries.where("size > 1").select(*ENTRY, "size"), ENTRY, "size")
    span = F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n") + length - 1).alias("hi"))
    equal = equal.groupBy("th").agg(F.collect_list(span).alias("equal"))
    at = F.struct("v", F.col("rep.start").alias("start"), "left", "n", (F.col("size") == 1).alias("alone"))
    places = entries.where("others > 0").groupBy(F.col("rep.th").alias("th")).agg(F.collect_list(at).alias("places"))
    owners = texts.select(F.substring("sha", 1, 16).alias("th"), "owner")
    asked = staged(places.join(equal, "th", "full").join(owners, "th").withColumnRenamed("th", "t"), "suffix-asked")
    named = docs.select("id", "bytes", F.substring(F.unhex(F.sha2("bytes", 256)), 1, 16).alias("th"))
    copies = texts.where((F.col("size") > 1) & (F.col("n") >= length)).select(F.substring("sha", 1, 16).alias("th"))
    words = name_filter(asked.select(F.col("t").alias("th")).unionByName(copies), "th")
    named = passed(named, "th", words).where("passed").drop("passed")
    asked_of = named.join(asked.hint("shuffle_hash"), (named["th"] == asked["t"]) & named["id"].eqNullSafe(asked["owner"]))
    asked_of = staged(asked_of.select("th", "bytes", "places", "equal"), "suffix-shared")
    cut = asked_of.where("places IS NOT NULL").select("th", "bytes", "places")
    cut = cut.mapInArrow(_cut(length), "v long, th binary, start long, left short, n short, alone boolean, s binary")
    spans = cut.repartition("v").sortWithinPartitions("v").mapInArrow(_find(length), "th binary, lo long, hi long")
    spans = spans.groupBy("th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    lost = asked_of.select("th", "bytes", "equal").dropDuplicates(["th"]).join(spans, "th", "left")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    both = F.concat(F.coalesce("equal", none), F.coalesce("spans", none))
    lost = lost.select("th", "bytes", both.alias("spans")).where(F.size("spans") > 0)
    return texts, join_hot(rows, texts.select("sha", "size"), ["sha"], "size"), lost, words


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    A null text counts as empty. Texts shorter than length lose nothing; texts that occur twice, rows that repeat
    included, lose all if they are as long as that. Strings are compared within and across texts, never across a border
    between texts, and are judged on the input. Texts are handled whole, however long: over PART bytes in parts that
    overlap by a string. An empty table gives an empty result; other columns are not read.
    """
    assert GRAMS[-2] < length < 4096, "length is out of range"
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("bytes"))
    texts, entries, lost, words = repeated_spans(rows, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [_take_out(t, [(s["lo"], s["hi"]) for s in spans]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x[2]) for x in out], pa.int64()), pa.array([x[0] for x in out], pa.binary())],
                names=["th", "n_removed", "n_spans", "left_over"],
            )

    edited = lost.select("th", "bytes", "spans").mapInArrow(run, "th binary, n_removed long, n_spans long, left_over binary")
    shape = lambda df, **named: df.select(
        F.col("id").alias(id_col), *[named[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept")], F.sha2(named["kept"], 256).alias("kept_sha256")
    )
    none, size = F.lit(0).cast("long"), F.octet_length("bytes").cast("long")
    short = shape(rows.where(size < length), n_bytes=size, n_removed=none, n_spans=none, kept=F.col("bytes"))
    # copies lose all; the most frequent ones are passed over before texts move
    copies = (F.col("size") > 1) & (F.col("n") >= length)
    whole = shape(entries.where(copies), n_bytes=F.col("n"), n_removed=F.col("n"), n_spans=F.lit(1).cast("long"), kept=F.lit(b""))
    th = lambda c: F.substring(c, 1, 16)
    hot = texts.where(copies).orderBy(F.desc("size"), "sha").limit(HOT_KEYS).select(th("sha").alias("th"))
    long = passed(rows.where(size >= length).withColumn("th", th(F.unhex(F.sha2("bytes", 256)))), "th", words)
    alone = shape(long.where("NOT passed"), n_bytes=size, n_removed=none, n_spans=none, kept=F.col("bytes"))
    single = long.where("passed").join(F.broadcast(hot), "th", "left_anti")
    fate = texts.where(~copies & (F.col("n") >= length)).select(th("sha").alias("th")).join(edited, "th", "left")
    single = single.join(fate, "th")
    single = shape(single, n_bytes=size, n_removed=F.coalesce("n_removed", none), n_spans=F.coalesce("n_spans", none), kept=F.coalesce("left_over", "bytes"))
    return short.unionByName(whole).unionByName(alone).unionByName(single)
