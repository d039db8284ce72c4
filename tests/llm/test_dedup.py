"""Exact, suffix and near dedup against brute force, with the odd cases: nulls, blanks, repeats, empty tables, clashing names."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import sitesignal.llm.simhash as simhash
import sitesignal.llm.suffix_dedup as suffix
from sitesignal.llm import exact_dedup, mixing
from sitesignal.llm.common import staged
from sitesignal.llm.components import components
from sitesignal.llm.queries import ORACLES, QUERIES

CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, row string, run int, kept boolean, fp long, size int"


def odd(spark, texts):
    """Rows with many columns that the operators use names of themselves."""
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", "y", 2, True, 3, 4) for i, t in texts], CLASH)


ODD = [(5, "Same"), (9, "sAME"), (7, None), (8, ""), (9, "sAME"), (None, "same"), (3, "ÄB"), (4, "äb"), (6, " "), (11, "x" * 300_000)]


def test_op1_matches_sql(same):
    same(QUERIES["op1_exact_dedup"], ORACLES["op1_exact_dedup"])


@pytest.mark.parametrize("keep, same_id, blank_id", [("largest", 9, 8), ("smallest", 5, 7)])
def test_exact_dedup_of_odd_rows(spark, keep, same_id, blank_id):
    rows = exact_dedup.exact_dedup(odd(spark, ODD), keep=keep, fan_in=2).collect()
    assert len(rows) == len(ODD)
    by = Counter((r.keep_id, r.group_size) for r in rows)
    assert by == {(same_id, 4): 4, (blank_id, 2): 2, (3, 1): 1, (4, 1): 1, (6, 1): 1, (11, 1): 1}
    assert sum(r.kept for r in rows) == 6  # rows that repeat the identifier that stays: one of them
    assert {r.text_sha256 for r in rows if r.doc_id == 9} == {hashlib.sha256(b"same").hexdigest()}
    kept = exact_dedup.keep_first(odd(spark, ODD), keep=keep)
    assert kept.columns == odd(spark, ODD).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([same_id, blank_id, 3, 4, 6, 11])


def test_empty_tables(spark):
    none = odd(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.keep_first(none).count() == 0
    assert suffix.suffix_dedup(none).count() == 0
    assert simhash.near_dedup(none).count() == 0 and simhash.keep_first(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(none, keep="any")


def brute_suffix(texts, length):
    """doc -> (bytes, removed, runs, hash of what is left)."""
    raw = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((i, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


def passages(seed, alphabet="abcdefgh é"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    base, line = word(2500), word(150)
    texts = []
    for i in range(24):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(2000)
            parts.append(rng.choice([base[at : at + rng.randrange(300, 900)], word(rng.randrange(400)), line, line + word(260)]))
        texts.append((i, "".join(parts)))
    texts += [(30, texts[0][1]), (31, texts[0][1]), (32, None), (33, ""), (34, "a" * 401), (35, "b" * 400), (36, "a\0" * 300), (37, "zz" + "a\0" * 300), (38, "c" * 2000), (30, "d" * 399)]
    return texts


@pytest.mark.parametrize("large", [32768, 3])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(suffix, "LARGE", large)
    texts = passages(large)
    rows = suffix.suffix_dedup(odd(spark, texts)).collect()
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows], key=str)
    assert got == brute_suffix(texts, 400)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)


def test_filter_passes_all_names(spark, monkeypatch):
    """With fewer bits than names more rows pass, and none that is asked for is lost."""
    from sitesignal.llm import common

    rows = spark.range(2000).selectExpr("cast(id AS string) AS name")
    for bits, most in ((24, 0), (7, 2000)):
        monkeypatch.setattr(common, "FILTER", bits)
        out = common.passed(rows, "name", common.name_filter(rows.where("name < '3'"), "name")).collect()
        assert all(r.passed for r in out if r.name < "3") and sum(r.passed for r in out if r.name >= "3") <= most
    monkeypatch.setattr(common, "FILTER", 6)
    monkeypatch.setattr(suffix, "LARGE", 3)
    texts = passages(3)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.suffix_dedup(odd(spark, texts)).collect()], key=str)
    assert got == brute_suffix(texts, 400)


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(suffix, "PART", 4096)
    monkeypatch.setattr(suffix._Powers, "made", None)
    rng = random.Random(1)
    long = bytes(rng.randrange(97, 110) for _ in range(20_000))
    whole = list(suffix.text_stretches([long], 400))
    starts = Counter(p for _, start, _, n, _ in whole for s, k in zip(start.tolist(), n.tolist(), strict=True) for p in range(s, s + k))
    assert set(starts) == set(range(len(long) - 399)) and set(starts.values()) == {1}
    monkeypatch.setattr(suffix, "PART", 1 << 20)
    monkeypatch.setattr(suffix._Powers, "made", None)
    named = lambda xs: {s + left: int(v) for _, start, lefts, _, vs in xs for s, left, v in zip(start.tolist(), lefts.tolist(), vs.tolist(), strict=True)}
    assert named(whole) == named(suffix.text_stretches([long], 400))


def test_op2_against_brute_force(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op2_suffix_dedup"](spark, sf).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows], key=str) == brute_suffix(texts, 400)
    whole = [r for r in rows if "\ufffd" not in r.kept_text]
    assert len(whole) > 0.9 * len(rows) and all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in whole)


def brute_print(text, words=4):
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(items, linked):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


@pytest.mark.parametrize("shard", [4096, 2])
def test_op3_against_brute_force(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in texts]
    classes = brute_classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for (i, _), c in zip(texts, classes, strict=True):
        first[c] = min(first.get(c, i), i)
    want = {(i, f"{p:016x}", first[c]) for (i, _), p, c in zip(texts, prints, classes, strict=True)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, sf).collect()} == want


def test_near_dedup_of_odd_rows(spark):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_dedup(odd(spark, ODD)).collect()}
    zero = "0" * 16
    assert rows[7, zero] == rows[8, zero] == rows[6, zero] == 6
    assert rows[9, f"{brute_print('same'):016x}"] == 5 and rows[None, f"{brute_print('same'):016x}"] == 5


@pytest.mark.parametrize("seed, radius", [(1, 4), (2, 1), (3, 6)])
def test_bk_forest_finds_all(seed, radius):
    rng = np.random.default_rng(seed)
    value = np.unique(rng.integers(0, 2**18, 700).astype(np.uint64))
    rng.shuffle(value)
    group = np.sort(rng.integers(0, 7, len(value)))
    forest = simhash.Forest(group, value)
    got = {(int(a), int(b)) for q, n in forest.search(np.arange(len(value)), value, forest.root, radius) for a, b in zip(q, n, strict=True)}
    assert got == {(i, j) for i in range(len(value)) for j in range(len(value)) if group[i] == group[j] and int(value[i] ^ value[j]).bit_count() <= radius}


def test_every_pair_within_the_radius_shares_a_shard():
    rng = random.Random(5)
    for radius, blocks in ((4, 6), (5, 7)):
        masks = simhash.block_masks(radius, blocks)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            assert any((a ^ b) & (m % (1 << 64)) == 0 for m in masks)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[k] for k in range(100, 160)}) == 1 and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    texts, i = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for k in rng.sample(range(len(copy)), int(len(copy) * rng.choice([0, 0.005, 0.01, 0.02, 0.2]))):
                copy[k] = word()
            texts.append((i, " ".join(copy)))
            i += 1
    return texts


def sets_of(text):
    parts = text.lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def test_similar_groups_against_brute_force(spark):
    texts = [*near_copies(), (900, None), (901, ""), (902, "one two"), (903, "One two"), (902, "one two")]
    shingles = [sets_of(t or "") for _, t in texts]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    classes = brute_classes(shingles, like)
    want = {min(i for (i, _), c in zip(texts, classes, strict=True) if c == k) for k in set(classes)}
    kept = [r.doc_id for r in simhash.keep_first(odd(spark, texts)).collect()]
    assert len(kept) == len(set(kept))
    assert want <= set(kept), "a text that is like no other must stay"
    assert len(set(kept) - want) <= 0.1 * (len(texts) - len(want)), "candidates find nine of ten at least"


def test_links_are_short_and_real(spark):
    rng = np.random.default_rng(4)
    value = np.unique(rng.integers(0, 2**20, 400)).astype(np.int64)
    df = spark.createDataFrame([(int(v),) for v in value], "fp long")
    links = simhash.near_links(df, radius=3, blocks=5, real=True).distinct().collect()
    assert all((r.a ^ r.b).bit_count() <= 3 for r in links)
    classes = brute_classes(value.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    label = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    found = [label.get(v, v) for v in value.tolist()]
    assert len(set(zip(classes, found, strict=True))) == len(set(classes)) == len(set(found))


def exactly_the_first(spark, texts):
    shingles = [sets_of(t) for _, t in texts]
    classes = brute_classes(shingles, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    want = {min(i for (i, _), c in zip(texts, classes, strict=True) if c == k) for k in set(classes)}
    assert len(want) < len(texts)
    assert sorted(r.doc_id for r in simhash.keep_first(odd(spark, texts)).collect()) == sorted(want)


def test_near_copies_among_unlike_texts_of_near_word_sets(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(150):
        base = rng.sample(vocabulary, 140)
        texts.append((i, " ".join(base)))
        if i % 5 == 0:
            for k in rng.sample(range(10, 130), 2):
                base[k] = rng.choice(vocabulary)
            texts.append((1000 + i, " ".join(base)))
    exactly_the_first(spark, texts)


def test_near_copies_beside_other_orders_of_the_same_words(spark):
    rng = random.Random(9)
    a = [f"w{k}" for k in range(100)]
    other = rng.sample(a, 100)
    texts = [(1, " ".join(other)), (2, " ".join(a)), (3, " ".join([*a[:-2], a[-1], a[-2]])), (4, " ".join([a[1], a[0], *a[2:], "one"]))]
    exactly_the_first(spark, texts)


def test_near_copies_of_short_and_longer_texts_at_the_least_similarity(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    texts = []
    for i in range(60):
        n = rng.choice([20, 20, 60, 200])
        base = [word() for _ in range(n)]
        texts += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [word() for _ in range((n - 4) // 4)]))]
    exactly_the_first(spark, texts)


def test_shingles_that_come_last_lose_no_pair(spark):
    rng = random.Random(11)
    line = " ".join(f"c{k}" for k in range(14))
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for i in range(400):
        base = [word() for _ in range(rng.choice([2, 30]))]
        texts.append((i, " ".join([line, *base])))
        if i % 20 == 0:
            texts.append((1000 + i, " ".join([line, *base, word()])))
    exactly_the_first(spark, texts)


def test_runs_are_merged_by_sorting(spark):
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "doc_id long, text string").repartition(8)
    entries = staged(exact_dedup.digests(docs), "test-digests")
    runs = entries.select("run", "h", "sha", "n", exact_dedup.F.struct("id").alias("best"), exact_dedup.F.lit(1).alias("size"))
    plan = exact_dedup._merge(runs, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 2 and "HashAggregate" not in plan


def test_columns_that_clash_come_through(spark):
    words = " ".join(f"w{k}" for k in range(40))
    names = ["__key", "__sha", "__copy", "__text", "key", "doc", "id", "sha", "copies", "rows", "token", "cell"]
    rows = [(k, words if k < 3 else f"{words} {k} " * k, "s", *[f"{n}-{k}" for n in names]) for k in range(8)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for kept in (exact_dedup.keep_first(docs), simhash.keep_first(docs), mixing.take(docs)):
        out = kept.collect()
        assert kept.columns == docs.columns and out
        assert all(r[n] == f"{n}-{r.doc_id}" for r in out for n in names)


def test_settings_are_left_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    simhash.near_dedup(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")).collect()
    assert spark.conf.get(name) == before
