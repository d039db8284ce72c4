"""Mixing sources to target weights, by cube-method balanced sampling.

A source's target is water-filled: by weight, at most `repeat` times what the source has. A document is then taken
floor(r) or floor(r) + 1 times, where r is its source's target over its size; the fraction of r is the inclusion
probability of the extra copy. The cube method draws the extra copies: the vector of probabilities walks, by random
steps within the null space of the constraints (number of documents, number of words), until all but two entries of a
group are 0 or 1. A source is cut into groups by a hash of the document, all groups fly at the same time, and what they
leave undecided is gathered into fewer groups, which fly again, until one group is left in each source, which is
landed so that the source's words are missed least. Totals are kept through all flights, so what a source misses is what
its landing misses: a few words, where the last group has documents enough to choose from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.common import row_key, staged

#: Documents in a group of a flight, on average.
GROUP = 256
#: Documents of a group that sit out all flights but the last, so that the landing has documents of all lengths.
RESERVE = 32
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size (words), key and row for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        row_key(id_col, text_col).alias("key"), F.monotonically_increasing_id().alias("row"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """rows (staged) with again: the number, from 0, of a row among those that repeat its identifier, size and source.

    Repeats are numbered within each input partition first, then partitions of one key follow each other, so rows that
    repeat a thousand times, or null identifiers, are no hot key.
    """
    key = F.xxhash64(F.col("id").isNull(), "id", "size", F.col("source").isNull(), "source")
    part = F.shiftright("row", 33)
    keyed = rows.withColumns({"name": key, "part": part})
    if not keyed.groupBy("name").count().where("count > 1").limit(1).count():
        return rows.withColumn("again", F.lit(0).cast("long"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("name", "part").count()
    counts = counts.select("name", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("name", "part").orderBy("row"))
    out = keyed.withColumn("rank", rank).join(counts, ["name", "part"])
    return staged(out.select(*rows.columns, (F.col("before") + F.col("rank") - 1).alias("again")), "mix-numbered")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeat: float = 3.0) -> DataFrame:
    """source, source_size, n, target from one row for each source (source, source_size, n).

    Sources in code point order, null last, get the weights in turn. A source is full when its share of the level
    exceeds repeat times its size; sources fill in the order of that ratio, so the level follows from running sums.
    The rows are sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    weighed = sources.withColumn("weight", turn).withColumn("most", F.lit(float(repeat)) * F.col("source_size"))
    fills = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy(F.lit(1))
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    # the first source that does not fill sets the level for all that follow
    final = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("full"), "level")))
    ranked = ranked.withColumn("final", final.over(whole)["level"])
    share = F.col("final") * F.col("weight")
    return ranked.select("source", "source_size", "n", F.coalesce(F.least("most", share), "most").alias("target"))


def draw(key: int, turn: int) -> float:
    """A number in [0, 1) that depends on its arguments only."""
    x = (key * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def flight(p: list[float], size: list[float], key: list[int]) -> list[float]:
    """The flight phase for constraints sum(p) and sum(p * size): all but two entries at most become 0 or 1."""
    eps = 1e-9
    p = list(p)
    waiting = [k for k in range(len(p)) if eps < p[k] < 1 - eps]
    p = [x if eps < x < 1 - eps else float(round(x)) for x in p]
    hand: list[int] = []
    turn = 0
    waiting.reverse()
    while True:
        while len(hand) < 3 and waiting:
            hand.append(waiting.pop())
        pair = next(((a, b) for i, a in enumerate(hand) for b in hand[i + 1 :] if size[a] == size[b]), None)
        if pair:
            move = [(pair[0], 1.0), (pair[1], -1.0)]
        elif len(hand) == 3:
            a, b, c = hand
            move = [(a, size[b] - size[c]), (b, size[c] - size[a]), (c, size[a] - size[b])]
            scale = max(abs(u) for _, u in move)
            move = [(k, u / scale) for k, u in move]
        else:
            return p
        up = min((1 - p[k]) / u if u > 0 else p[k] / -u for k, u in move if u)
        down = min(p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in move if u)
        turn += 1
        step = up if draw(key[hand[0]], turn) * (up + down) < down else -down
        for k, u in move:
            p[k] += step * u
            if p[k] < eps or p[k] > 1 - eps:
                p[k] = float(round(p[k]))
        hand = [k for k in hand if 0.0 < p[k] < 1.0]


def landing(before: list[float], p: list[float], size: list[float]) -> list[float]:
    """Lands the last group of a source: before holds its probabilities at the start, p those after the flight.

    The entries that are left are rounded so that least is missed. Where one very long document makes that much, single
    documents of the group are then flipped, or two exchanged, as long as what is missed shrinks. Missed are the words,
    and to break near-ties the documents at a quarter of the mean length each.
    """
    s, start = np.array(size, dtype=np.float64), np.array(before, dtype=np.float64)
    unit = 0.25 * float(s.mean())
    cost = lambda words, docs: np.abs(words) + unit * np.abs(docs)
    left = [k for k in range(len(p)) if 0.0 < p[k] < 1.0]
    x = np.array(p, dtype=np.float64)
    best = None
    for choice in range(1 << len(left)):
        for bit, k in enumerate(left):
            x[k] = choice >> bit & 1
        words, docs = float(((x - start) * s).sum()), float((x - start).sum())
        if best is None or cost(words, docs) < best[0]:
            best = (cost(words, docs), x.copy())
    x = best[1]
    for _ in range(32):
        words, docs = float(((x - start) * s).sum()), float((x - start).sum())
        flip = 1 - 2 * x  # what a flip adds to the documents
        one = cost(words + flip * s, docs + flip)
        on, off = np.flatnonzero(x == 0), np.flatnonzero(x == 1)
        two = cost(words + s[on][:, None] - s[off][None, :], docs)
        now = cost(words, docs)
        least_two = float(two.min()) if two.size else np.inf
        if min(float(one.min()), least_two) >= now - 1e-6:
            break
        if least_two < float(one.min()):
            a, b = np.unravel_index(int(two.argmin()), two.shape)
            x[on[a]], x[off[b]] = 1.0, 0.0
        else:
            k = int(one.argmin())
            x[k] = 1 - x[k]
    return x.tolist()


def _fly(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # long documents first: what is left at the end is short, and so is the miss
        group = group.sort_values(["size", "h", "row"], ascending=[False, True, True], kind="stable")
        before, size = group["p"].tolist(), group["size"].tolist()
        key = group["h"].tolist()
        if last:
            return group.assign(p=landing(before, flight(before, size, key), size))
        flies = sorted(range(len(key)), key=lambda k: (key[k], k))[RESERVE:]
        flies.sort()
        p = list(before)
        for k, x in zip(flies, flight(*[[c[k] for k in flies] for c in (before, size, key)]), strict=True):
            p[k] = x
        return group.assign(p=p)

    return run


def take(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeat: int = 3, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of docs as many times as the mix takes them, with all their columns.

    Rows that repeat identifier and text count as one document, taken as often as all of them together.
    """
    mixed = mix(docs, weights, repeat, id_col, text_col, source_col, keyed=True)
    copies = mixed.where("taken > 0").groupBy("key").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("copies"), F.count(F.lit(1)).alias("rows"))
    copies = staged(copies, "mix-copies")
    keyed = docs.select(F.struct("*").alias("doc"), row_key(id_col, text_col).alias("key"))
    found = keyed.join(copies.hint("shuffle_hash"), "key")
    if copies.where("rows > 1").limit(1).count():
        found = found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["key"]))
    return found.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeat: int = 3, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", keyed: bool = False,
) -> DataFrame:
    """One row for each row of docs: id_col, size, source_size, target, taken (words the mix takes, repeats counted).

    A null text has size 0; a null source is a source of its own, last in order. Documents without words take nothing.
    taken is size times 0 to `repeat`. Reruns agree: every draw depends on identifiers, sizes and sources only; among rows
    that repeat all three, which of them is taken is open, but how many is not. An empty table gives an empty result.
    Other columns are not read. keyed: with row_key in a further column, key.
    """
    rows = numbered(staged(sizes(docs, id_col, text_col, source_col), "mix-sizes"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    goal = staged(targets(sources, weights, repeat), "mix-targets")
    few = goal.count() <= BROADCAST_SOURCES
    per_source = F.broadcast(goal.withColumnRenamed("source", "s")) if few else goal.withColumnRenamed("source", "s")
    joined = rows.join(per_source, rows["source"].eqNullSafe(per_source["s"])).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.round(ratio, 12))
    plan = joined.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), F.round(ratio, 12) - F.col("whole")))
    # groups of about GROUP documents in each source
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP))
    plan = plan.withColumn("h", F.xxhash64("id", "size", "again", F.lit("mix"))).withColumn("groups", groups)
    flying = plan.where((F.col("p") > 0) & (F.col("size") > 0)).select("row", "source", "size", "p", "h", "groups")
    flying = staged(flying.withColumn("group", F.pmod("h", "groups")), "mix-start")
    schema = flying.schema
    done, level = None, 0
    while True:
        most = flying.agg(F.max("groups")).first()[0]
        if most is None:
            break
        last = most <= 1
        flown = staged(flying.groupBy("source", "group").applyInPandas(_fly(last), schema), "mix-flight")
        settled = flown.where("p >= 1").select("row")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        level += 1
        # the reserve and two documents of each group are left: that many fewer groups hold them
        fewer = F.greatest(F.lit(1), F.ceil(F.col("groups") * (RESERVE + 2) / GROUP)).cast("long")
        left = flown.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("groups", fewer)
        flying = staged(left.withColumn("group", F.pmod(F.xxhash64("h", F.lit(level)), "groups")).select(*schema.names), "mix-left")
    extra = F.lit(0)
    if done is not None:
        plan = plan.join(done.select("row", F.lit(1).alias("one")), "row", "left")
        extra = F.coalesce("one", F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0))
    taken = (F.col("size") * copies).cast("long").alias("taken")
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, *["key"] * keyed)
