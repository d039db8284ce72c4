"""Chat formatting by quotation linking, with DataFrame operations only.

A message's lines carry a quote level (the number of > in front). Runs of lines of one level are passages; passages and
their lines are normalised and hashed, and so is what each message says itself. A quoted hash is joined to the latest
earlier message of the conversation that says it. A message replies to the message that most of its first-level quotes
come from; without a match, deeper levels are tried, then it replies to the message before it. A conversation is a tree
then: a reply continues its parent's branch if it is the first to do so, others open a branch of their own. Messages
come without quotes, ordered by branch and turn, so that each reply stands after what it replies to.

No step gathers a conversation: what is ordered within one is cut into stretches of STRETCH turns, each is ordered by
itself, and only one row for each stretch is ordered across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.common import staged

#: Turns in a stretch.
STRETCH = 256
#: Shortest normalised line that links; a shorter one (a bare "yes") says nothing about where it comes from, unless it is
#: all that a message says.
LEAST = 12
QUOTED = r"^[ \t]*((?:>[ \t]?)+)"
#: Lines by which mail programs introduce a quote.
INTRODUCES = r"(?i)^(on|am|le|el) .*(wrote|schrieb.*|écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    """Lower case, white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed(text: Column) -> Column:
    """An array of (level, content), one for each line."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTED, 1), "[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTED, "").alias("content")))


def own_text(lines: Column) -> Column:
    """What a message says itself, from its parsed lines: no quotes, nor the lines that introduce them."""

    def own(x: Column, i: Column) -> Column:
        introduces = x["content"].rlike(INTRODUCES) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~introduces

    text = F.array_join(F.transform(F.filter(lines, own), lambda x: x["content"]), "\n")
    return F.regexp_replace(text, r"^\s*\n|\s+$", "")


def _pieces(df: DataFrame, text: str) -> DataFrame:
    """df with piece and weight for each whole text of column text, and each of its lines that is long enough. A short
    whole text is marked, so that it is equal to short whole texts only."""
    whole = normalised(F.col(text))
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: F.length(x) >= LEAST)
    long = F.filter(F.array(whole), lambda x: F.length(x) >= LEAST)
    pieces = F.array_distinct(F.concat(long, lines))
    short = F.when((F.length(whole) > 0) & (F.length(whole) < LEAST), F.array(F.concat(F.lit("\x01"), whole)))
    return (
        df.withColumn("said", F.explode(F.concat(pieces, F.coalesce(short, F.array().cast("array<string>")))))
        .withColumn("piece", F.sha2("said", 256))
        .withColumn("weight", F.length(F.ltrim("said", F.lit("\x01"))).cast("long"))
        .drop("said", text)
    )


def _quoted(messages: DataFrame) -> DataFrame:
    """conv, turn, level, passage: runs of lines of one level."""
    lines = messages.where(F.exists("lines", lambda x: x["level"] > 0))
    lines = lines.select("conv", "turn", "key", F.posexplode("lines").alias("at", "line")).where("line.level > 0")
    same = Window.partitionBy("key", "line.level").orderBy("at")
    runs = lines.withColumn("run", F.col("at") - F.row_number().over(same))
    passage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line.content"))), lambda x: x["content"]), "\n")
    return runs.groupBy("conv", "turn", "key", F.col("line.level").alias("level"), "run").agg(passage.alias("passage"))


def _latest_before(asked: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, turn) with `found`: the largest turn of there (keys, turn) below its own; null if none.

    Both sides hold no repeats. Within a stretch by a join of at most STRETCH turns each, across stretches by the
    running maximum of one row for each stretch.
    """
    stretch = F.floor(F.col("turn") / STRETCH).cast("long")
    asked, there = asked.withColumn("stretch", stretch), there.withColumn("stretch", stretch)
    near = asked.join(there.withColumnRenamed("turn", "t"), [*keys, "stretch"]).where("t < turn")
    near = near.groupBy(*keys, "turn").agg(F.max("t").alias("near"))
    ends = there.groupBy(*keys, "stretch").agg(F.max("turn").alias("end"))
    marks = asked.select(*keys, "stretch").distinct().join(ends, [*keys, "stretch"], "full")
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("far", F.max("end").over(earlier)).select(*keys, "stretch", "far")
    out = asked.join(near, [*keys, "turn"], "left").join(marks, [*keys, "stretch"], "left")
    return out.withColumn("found", F.coalesce("near", "far")).drop("near", "far", "stretch")


def link_replies(messages: DataFrame) -> DataFrame:
    """conv, turn, prev, parent, linked for each (conv, turn) of staged messages (conv, turn, key, lines, own)."""
    turns = staged(messages.select("conv", "turn").distinct(), "turns")
    quotes = staged(_pieces(_quoted(messages), "passage").groupBy("conv", "turn", "level", "piece").agg(F.max("weight").alias("weight")), "quotes")
    known = quotes.select("conv", "piece").distinct()
    said = _pieces(messages.select("conv", "turn", "own"), "own").select("conv", "piece", "turn")
    said = staged(said.join(known, ["conv", "piece"], "left_semi").distinct(), "said")
    asked = quotes.select("conv", "piece", "turn").distinct()
    found = _latest_before(asked, said, ["conv", "piece"]).where(F.col("found").isNotNull())
    votes = quotes.join(found, ["conv", "piece", "turn"]).groupBy("conv", "turn", "level", "found").agg(F.sum("weight").alias("weight"))
    best = F.max_by("found", F.struct(-F.col("level"), "weight", "found"))
    voted = votes.groupBy("conv", "turn").agg(best.alias("voted"))
    before = _latest_before(turns, turns, ["conv"])
    out = before.join(voted, ["conv", "turn"], "left")
    return out.select("conv", "turn", F.col("found").alias("prev"), F.coalesce("voted", "found").alias("parent"), F.col("voted").isNotNull().alias("linked"))


def _latest_up_to(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the largest non-null value in the rows of keys up to their own turn, stretch by stretch."""
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH).cast("long"))
    ends = rows.groupBy(*keys, "stretch").agg(F.max(value).alias("end"))
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "stretch", F.max("end").over(earlier).alias("far"))
    near = F.max(value).over(Window.partitionBy(*keys, "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("near", near).join(ends, [*keys, "stretch"])
    return out.withColumn(name, F.greatest("near", "far")).drop("near", "far", "stretch")


def _branches(replies: DataFrame) -> DataFrame:
    """replies with branch: the turn that opened the branch.

    Turns that each go on from the turn before are one run; only runs that go on from an older turn are followed, by
    pointers that double in length in each round.
    """
    first = replies.where(F.col("parent").isNotNull()).groupBy("conv", "parent").agg(F.min("turn").alias("first"))
    rows = replies.join(first, ["conv", "parent"], "left").withColumn("goes_on", F.coalesce(F.col("turn") == F.col("first"), F.lit(False)))
    opens = F.when(~F.col("goes_on") | (F.col("parent") != F.col("prev")), F.col("turn"))
    rows = staged(_latest_up_to(rows.withColumn("opens", opens), ["conv"], "opens", "run"), "runs")
    back = rows.where((F.col("opens") == F.col("turn")) & F.col("goes_on")).select("conv", F.col("turn").alias("from"), F.col("parent").alias("turn"))
    back = staged(back.join(rows.select("conv", "turn", "run"), ["conv", "turn"]).select("conv", "from", F.col("run").alias("to")), "back")
    while True:
        hop = back.select("conv", F.col("from").alias("to"), F.col("to").alias("beyond"))
        moved = staged(back.join(hop, ["conv", "to"], "left").select("conv", "from", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "back")
        back = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    heads = back.select("conv", F.col("from").alias("run"), F.col("to").alias("branch"))
    rows = rows.join(heads, ["conv", "run"], "left").withColumn("branch", F.coalesce("branch", "run"))
    return rows.select("conv", "turn", "parent", "linked", "branch")


def _positions(rows: DataFrame) -> DataFrame:
    """rows with position: the rank of turn in (conv, branch), stretch by stretch."""
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH).cast("long"))
    keys = ["conv", "branch", "stretch"]
    counts = rows.groupBy(*keys).count()
    earlier = Window.partitionBy("conv", "branch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("turn"))
    return rows.withColumn("rank", rank).join(counts, keys).withColumn("position", F.col("before") + F.col("rank")).drop("rank", "before", "stretch")


def link_quotations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each row of messages: conv_id, branch, position, turn, parent_turn, linked, role, text, chat.

    text is without quotes, chat is text in its role's frame; (conv_id, branch, position) is the reply order. linked
    tells that a quote, not the turn before, chose the parent. A null text is empty, a null role is 'user'. Turns are
    whole numbers. A row without conversation or turn stands alone: branch and parent are null, position is 1. Rows that
    repeat conversation and turn share parent, branch and position; all of them count as what that turn says. A quote
    of nothing earlier links nothing; one of fewer than LEAST characters links to a message that says just that. Texts are
    taken whole, however long. An empty table gives an empty result. Other columns are not read.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
        parsed(F.col(text_col)).alias("lines"),
    )
    rows = rows.withColumn("own", own_text(F.col("lines"))).withColumn("key", F.monotonically_increasing_id())
    rows = staged(rows, "messages")
    whole = rows.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    replies = staged(link_replies(whole), "replies")
    placed = _positions(_branches(replies))
    chat = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"))
    named = lambda df: df.select(
        F.col("conv").alias("conv_id"), "branch", F.col("position").cast("long").alias("position"), "turn",
        F.col("parent").alias("parent_turn"), "linked", "role", F.col("own").alias("text"), chat.alias("chat"),
    )
    alone = rows.where(F.col("conv").isNull() | F.col("turn").isNull())
    alone = alone.select("*", *[F.lit(None).cast("long").alias(c) for c in ("branch", "parent")], F.lit(1).alias("position"), F.lit(False).alias("linked"))
    return named(whole.join(placed, ["conv", "turn"])).unionByName(named(alone))
