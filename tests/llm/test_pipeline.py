"""Each stage on what the stage before has kept, against a plain version of it."""

import pytest

import corpus_pipeline
from sitesignal.llm import quality
from sitesignal.llm.common import staged


@pytest.fixture(scope="module")
def kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = staged(stage(spark, docs, sf), f"test-{name}")
    return out


def test_stages_keep_the_columns(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert all(kept[n].columns == kept[""].columns for n in names[:-1])


def test_quality_stage(spark, sf, kept):
    docs = kept[""]
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted == 1}
    assert {r.doc_id for r in kept["quality"].collect()} == good


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact_stage(kept):
    first = {}
    for r in kept["quality"].collect():
        first[lower(r.text)] = min(first.get(lower(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"].collect()) == sorted(first.values())


def test_near_stage(kept):
    rows = kept["exact_dedup"].collect()
    sets = {}
    for r in rows:
        parts = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i for i in ids if find(i) == i}
    found = {r.doc_id for r in kept["near_dedup"].collect()}
    assert want <= found and len(found - want) <= max(1, 0.1 * (len(ids) - len(want)))


def test_mixing_stage(kept):
    before = {r.doc_id: r for r in kept["near_dedup"].collect()}
    after = kept["mixing"].collect()
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert tuple(r) == tuple(before[r.doc_id])
    assert max(copies.values()) <= 3
    words = lambda r: len((r.text or "").encode().split())
    total = sum(words(r) for r in before.values())
    assert abs(sum(words(r) for r in after) - total) < 0.05 * total


def test_run_gives_the_tokens(spark, sf, kept):
    from tokenizers import Tokenizer

    from sitesignal.llm.queries import tokenizer_file

    library = Tokenizer.from_file(tokenizer_file())
    texts = [(r.doc_id, r.text) for r in kept["mixing"].collect()]
    want = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_stages_take_odd_tables(spark, sf):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "Some words. And more of them.", "en", None, 5), (3, "Some words. And more of them.", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, size int")
    for name, stage in corpus_pipeline.STAGES[1:]:
        for table in (docs, docs.where("doc_id > 99")):
            out = stage(spark, table, sf)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= 3 * table.count()
    empty = corpus_pipeline.quality_stage(spark, docs.where("doc_id > 99"), sf)
    assert empty.count() == 0 and corpus_pipeline.quality_stage(spark, docs, sf).columns == docs.columns
