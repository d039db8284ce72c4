"""The llm queries: each op applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.llm.bpe import bpe_round_trip
from sitesignal.llm.exact_dedup import exact_dedup
from sitesignal.llm.html_extract import extract_text
from sitesignal.llm.langid import language_id
from sitesignal.llm.mixing import mix
from sitesignal.llm.quality import score, train
from sitesignal.llm.quotes import link_quotations
from sitesignal.llm.simhash import near_dedup
from sitesignal.llm.suffix_dedup import suffix_dedup
from sitesignal.llm.topk import top_k
from sitesignal.session import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), length=400)
    # a cut may part the bytes of a character: what is no character then is U+FFFD in the text, not in kept_sha256
    return out.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=4, radius=4)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0), repeat=3)


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_simhash, op4_bpe, op5_topk, op6_mixing, op7_html_text, op8_quotations, op9_language_id, op10_quality)}

ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op5_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op8_quotations": r"""
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS t FROM conversations),
        l0 AS (SELECT k, conv_id, turn, unnest(string_split_regex(t, '\r?\n')) AS line, generate_subscripts(string_split_regex(t, '\r?\n'), 1) AS pos FROM m),
        l1 AS (
            SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
                regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') AS content
            FROM l0
        ),
        l2 AS (
            SELECT *, level = 0 AND NOT (
                    regexp_matches(content, '(?i)^(on|am|le|el) .*(wrote|schrieb.*|écrit|escribió)\s*:\s*$')
                    AND coalesce(lead(level) OVER (PARTITION BY k ORDER BY pos) > 0, false)
                ) AS is_own
            FROM l1
        ),
        o AS (
            SELECT m.k, m.conv_id, m.turn, m.role, regexp_replace(coalesce(x.own, ''), '^\s*\n|\s+$', '', 'g') AS own
            FROM m LEFT JOIN (SELECT k, string_agg(content, chr(10) ORDER BY pos) AS own FROM l2 WHERE is_own GROUP BY k) x USING (k)
        ),
        r AS (SELECT *, pos - row_number() OVER (PARTITION BY k, level ORDER BY pos) AS run FROM l2 WHERE level > 0),
        p AS (SELECT k, conv_id, turn, level, string_agg(content, chr(10) ORDER BY pos) AS passage FROM r GROUP BY k, conv_id, turn, level, run),
        q0 AS (
            SELECT conv_id, turn, level, true AS whole, passage AS x FROM p
            UNION ALL SELECT conv_id, turn, level, false, unnest(string_split(passage, chr(10))) FROM p
        ),
        q AS (
            SELECT DISTINCT conv_id, turn, level, piece FROM (SELECT *, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS piece FROM q0)
            WHERE length(piece) >= 12 OR whole AND length(piece) > 0
        ),
        s0 AS (
            SELECT conv_id, turn, true AS whole, own AS x FROM o
            UNION ALL SELECT conv_id, turn, false, unnest(string_split(own, chr(10))) FROM o
        ),
        s AS (
            SELECT DISTINCT conv_id, turn, piece FROM (SELECT *, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS piece FROM s0)
            WHERE length(piece) >= 12 OR whole AND length(piece) > 0
        ),
        f AS (
            SELECT q.conv_id, q.turn, q.level, q.piece, max(s.turn) AS found
            FROM q JOIN s ON q.conv_id = s.conv_id AND q.piece = s.piece AND s.turn < q.turn GROUP BY ALL
        ),
        v AS (SELECT conv_id, turn, level, found, sum(length(piece)) AS w FROM f GROUP BY ALL),
        b AS (SELECT conv_id, turn, arg_max(found, (-level, w, found)) AS voted FROM v GROUP BY ALL),
        t AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM o)),
        g AS (SELECT t.conv_id, t.turn, coalesce(b.voted, t.prev) AS parent, b.voted IS NOT NULL AS linked FROM t LEFT JOIN b USING (conv_id, turn)),
        h AS (SELECT *, parent IS NOT NULL AND turn = min(turn) OVER (PARTITION BY conv_id, parent) AS goes_on FROM g),
        c AS (
            SELECT conv_id, turn, turn AS branch FROM h WHERE NOT goes_on
            UNION ALL SELECT h.conv_id, h.turn, c.branch FROM h JOIN c ON h.goes_on AND h.conv_id = c.conv_id AND h.parent = c.turn
        ),
        z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, branch ORDER BY turn) AS position FROM c)
        SELECT o.conv_id, CAST(z.branch AS BIGINT) AS branch, CAST(z.position AS BIGINT) AS position, CAST(o.turn AS BIGINT) AS turn,
            CAST(h.parent AS BIGINT) AS parent_turn, h.linked, o.role, o.own AS text, '<|' || o.role || '|>' || chr(10) || o.own AS chat
        FROM o JOIN z USING (conv_id, turn) JOIN h USING (conv_id, turn)
    """,
}
