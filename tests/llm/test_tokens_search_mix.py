import hashlib
import math
import random

import numpy as np
import pytest

from sitesignal.llm import mixing, topk
from sitesignal.llm.bpe import ByteBPE, bpe_round_trip
from sitesignal.llm.common import staged
from sitesignal.llm.queries import ORACLES, QUERIES, tokenizer_file


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    with open(path, encoding="utf-8") as f:
        return ByteBPE(f.read()), Tokenizer.from_file(path)


def ids_of(bpe, text):
    return np.frombuffer(bpe.encode_bytes(text), "<u4").tolist()


@pytest.mark.parametrize("letters", ["ab", "the ingandof ", "aà日😀 \n\t'sdll01!", "   \r\n x", "\x1c\x85\xa0  a1"])
def test_encoding_is_that_of_the_library(both, letters):
    bpe, library = both
    rng = random.Random(len(letters))
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 120)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(bpe, text) == ids
        assert bpe.decode(bpe.encode_bytes(text)) == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_long_words(both):
    bpe, library = both
    for text in ("<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext", "x" * 20_000, "ab" * 5_000, "é" * 3_000):
        assert ids_of(bpe, text) == library.encode(text, add_special_tokens=False).ids
    assert bpe.decode(np.array([220, 128], "<u4").tobytes()) == library.decode([220, 128], skip_special_tokens=False)


def test_op4_against_the_library(spark, sf, both):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op4_bpe"](spark, sf).collect():
        e = both[1].encode(texts[r.doc_id], add_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é\n", None), (3, "é\n", None), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.n_tokens, r.decoded) for r in bpe_round_trip(df, tokenizer_file()).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, ""), (2, 0, ""), (3, 2, "é\n"), (3, 2, "é\n"), (None, 1, "a")], key=str)
    assert bpe_round_trip(df.where("doc_id > 5"), tokenizer_file()).count() == 0


def test_op5_matches_sql(same):
    same(QUERIES["op5_topk"], ORACLES["op5_topk"])


@pytest.mark.parametrize("block, first", [(2048, 8192), (16, 10)])
def test_top_k_of_odd_vectors(spark, monkeypatch, block, first):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "FIRST", first)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = random.Random(block)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(5)]) for i in range(120)]
    rows += [(i, [1.0, 2.0, 0.5, 0.0, 1.0]) for i in range(120, 160)]  # ties
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [1.0, math.nan, 1.0, 1.0, 1.0]), (204, [math.inf] * 5), (210, [0.0] * 5), (212, []), (214, [2.0, 1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, v in ok.items():
        if q % 2 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok.items() if i != q)
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])}
    got = topk.top_k(df, lambda i: i % 2 == 0).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, lambda i: i % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.where("vec_id > 5"), lambda i: i % 20 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e12, -3.0]), (1, [1e3, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(big, lambda i: i == 0).first().score == 64 * 10**12 * 64 * 10**3 + (-192) * 128


def waterfill(sizes, weights=(1, 2, 3), repeat=3):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(repeat * sizes[s] for s in full)
        level = rest / max(1e-300, sum(w[s] for s in sizes if s not in full))
        more = {s for s in sizes if s not in full and level * w[s] > repeat * sizes[s]}
        if not more:
            return {s: repeat * sizes[s] if s in full else level * w[s] for s in sizes}
        full |= more


def check_mix(rows, docs):
    by = {r.doc_id: r for r in rows}
    size = {i: len((t or "").encode().split()) for i, t, _ in docs}
    total = {}
    for i, _, s in docs:
        total[s] = total.get(s, 0) + size[i]
    target = waterfill(total)
    miss = {}
    for i, _, s in docs:
        r = by[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        miss[s] = miss.get(s, -target[s]) + r.taken
    return miss, target


def test_op6_meets_targets(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op6_mixing"](spark, sf).collect()
    miss, target = check_mix(rows, docs)
    assert abs(sum(miss.values())) < 0.05 * sum(target.values())
    again = QUERIES["op6_mixing"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("group, reserve, near", [(256, 16, 3), (16, 4, 40)])
def test_mix_of_many_and_hot_sources(spark, monkeypatch, group, reserve, near):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "RESERVE", reserve)
    rng = random.Random(2)
    docs = [(i, "w " * rng.randrange(1, 40), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    docs += [(1000, None, "hot"), (1001, "", None), (1002, "a b c", None), (1003, "x", "tiny"), (1004, "x\x0by\x85z", "tiny")]
    df = spark.createDataFrame([(i, t, s, "c", 1) for i, t, s in docs], "doc_id long, text string, source string, size string, target int")
    miss, target = check_mix(mixing.mix(df).collect(), docs)
    assert all(abs(m) <= near for s, m in miss.items() if target[s] > 100)
    taken = mixing.take(df)
    assert taken.columns == df.columns and {r.doc_id for r in taken.collect()} <= {i for i, *_ in docs}


def test_flight_keeps_totals():
    rng = random.Random(9)
    for _ in range(50):
        n = rng.randrange(1, 60)
        p, size = [rng.random() for _ in range(n)], [float(rng.randrange(1, 30)) for _ in range(n)]
        out = mixing.flight(p, size, list(range(n)))
        assert sum(0 < x < 1 for x in out) <= 2
        assert math.isclose(sum(out), sum(p), abs_tol=1e-6) and math.isclose(sum(a * b for a, b in zip(out, size, strict=True)), sum(a * b for a, b in zip(p, size, strict=True)), abs_tol=1e-4)


def test_mix_of_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "c", "t"), (None, "d e f", "t")], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 4 and sum(r.taken for r in rows) >= 6
    assert mixing.take(df).count() >= 3
    none = df.where("doc_id > 9")
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_mixing_of_rows_that_repeat(spark):
    """A third of all rows repeat one document, others have no identifier: no group of a flight is hot, targets are met."""
    rows = [(7, "a b c d", "x")] * 3000 + [(None, "e f g", "y")] * 2000 + [(100 + k, "w " * (1 + k % 9), "z") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rows = mixing.numbered(staged(mixing.sizes(docs, "doc_id", "text", "source"), "t"))
    again = [r.again for r in rows.where("id = 7").collect()]
    assert sorted(again) == list(range(3000)) and rows.where("id > 99 AND again > 0").count() == 0
    got = mixing.mix(docs).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert len(got) == 3 and all(abs(r["sum(taken)"] - r.target) <= 0.01 * r.target + 10 for r in got)
