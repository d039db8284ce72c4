"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its quantile bins, each chosen pair of features one over coarser bins.
Boosting goes round the features again and again: each turn fits a tree of at most four leaves to the current residuals
on one feature's bins and adds a small part of it to that feature's table; when the features are done, the pairs that
explain most of what is left are boosted in the same way. A score is the logistic of the sum of table entries, so
scoring is a search for bins and additions of whole arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import pieces
from sitesignal.llm.langid import held_out

#: Labelled rows that the model is fitted on, at most; those with the smallest hashes of their identifiers.
MAX_TRAIN = 30_000
#: Score from which a document counts as good.
ACCEPT = 0.7

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "capitals", "digits", "spaces", "stops", "exclamations", "pipes",
    "symbols", "other_marks", "distinct_words", "same_as_before", "repeated_lines", "repeated_pairs", "top_word", "log_lines",
    "line_words", "capitalised", "all_capitals", "marked_ends", "long_words", "one_letter", "runs", "entropy",
)

_SYMBOLS = b"#$%&*+=<>~^@\\/_{}[]"
_MARKED = re.compile(r"[^\w\s.,;:!?\"')]{2,}(?:\s|$)")
_RUN = re.compile(r"([^\w\s])\1\1")


def features(text: str | None) -> list[float]:
    """The numbers that describe a text, one for each of FEATURES; a null text is as an empty one."""
    text = text or ""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [np.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lower, upper, digit = int(counts[97:123].sum()), int(counts[65:91].sum()), int(counts[48:58].sum())
    space = int(counts[32] + counts[9:14].sum())
    symbols = sum(int(counts[b]) for b in _SYMBOLS)
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    shares = counts[counts > 0] / len(raw)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=m)
    common = Counter(words)
    lines = text.split("\n")
    pairs = Counter(zip(words, words[1:], strict=False))
    high = len(raw) - int(counts[:128].sum())
    return [
        np.log1p(n),
        np.log1p(m),
        n / m,
        (lower + upper + high) / len(raw),
        upper / max(1, lower + upper),
        digit / n,
        space / n,
        int(counts[46]) / m,
        int(counts[33]) / m,
        int(counts[124]) / m,
        symbols / m,
        max(0, marks - symbols - int(counts[46] + counts[33] + counts[124] + counts[44])) / m,
        len(common) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        1 - len(set(lines)) / len(lines),
        1 - len(pairs) / max(1, m - 1),
        common.most_common(1)[0][1] / m,
        np.log1p(len(lines)),
        m / len(lines),
        sum(w[:1].isupper() for w in words) / m,
        sum(w.isupper() for w in words) / m,
        len(_MARKED.findall(text)) / m,
        float((sizes > 18).mean()),
        float((sizes == 1).mean()),
        len(_RUN.findall(text)) / m,
        float(-(shares * np.log2(shares)).sum()),
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values by bin of a tree with at most `leaves` leaves, each over hessian `least`: greedy best cuts."""
    cuts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: np.square(a) / (b + 1.0)

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        at = np.arange(lo + 1, hi)
        lg, lh = cg[at] - cg[lo], ch[at] - ch[lo]
        tg, th = cg[hi] - cg[lo], ch[hi] - ch[lo]
        gain = gain_of(lg, lh) + gain_of(tg - lg, th - lh) - gain_of(tg, th)
        gain = np.where((lh >= least) & (th - lh >= least), gain, 0.0)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    while len(cuts) < leaves:
        found = [(*best(lo, hi), lo, hi) for lo, hi in cuts]
        gain, at, lo, hi = max(found)
        if gain <= 1e-12:
            break
        cuts.remove((lo, hi))
        cuts += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in cuts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return out


class AdditiveModel:
    """base + one table for each feature + one for each pair, over quantile bins."""

    def __init__(self, base: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple]):
        self.base, self.cuts, self.tables, self.pairs = base, cuts, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        for i, j, ci, cj, table in self.pairs:
            total += table[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.08, bins: int = 64, pairs: int = 8, pair_bins: int = 8) -> AdditiveModel:
        """x: rows by features; y: 0 or 1. Without rows the score is 0.5; with one label only it is near that label."""
        n, d = x.shape
        p = (y.sum() + 0.5) / (n + 1.0)
        base = float(np.log(p / (1 - p)))
        edges = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k)) if n else np.zeros(0)
        cuts = [edges(x[:, j], bins) for j in range(d)]
        tables = [np.zeros(len(c) + 1) for c in cuts]
        if not n or y.min() == y.max():
            return AdditiveModel(base, cuts, tables, [])
        at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
        total = np.full(n, base)
        least = max(1.0, n * p * (1 - p) / 2000)

        def residual() -> tuple[np.ndarray, np.ndarray]:
            q = 1.0 / (1.0 + np.exp(-total))
            return y - q, np.maximum(q * (1 - q), 1e-6)

        for _ in range(rounds):
            for j in range(d):
                g, h = residual()
                size = len(tables[j])
                step = rate * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), 4, least)
                tables[j] += step
                total += step[at[j]]
        g, h = residual()
        coarse = [edges(x[:, j], pair_bins) for j in range(d)]
        spot = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
        gains = []
        for i in range(d):
            for j in range(i + 1, d):
                cell, size = spot[i] * pair_bins + spot[j], pair_bins * pair_bins
                gains.append((float((np.square(np.bincount(cell, g, size)) / (np.bincount(cell, h, size) + 1.0)).sum()), i, j))
        chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
        grids = [np.zeros((pair_bins, pair_bins)) for _ in chosen]
        for _ in range(rounds // 4):
            for (i, j), grid in zip(chosen, grids, strict=True):
                g, h = residual()
                cell, size = spot[i] * pair_bins + spot[j], pair_bins * pair_bins
                gg, hh = np.bincount(cell, g, size).reshape(grid.shape), np.bincount(cell, h, size).reshape(grid.shape)
                # a cut along one feature, then one along the other on either side
                first = _tree(gg.sum(axis=1), hh.sum(axis=1), 2, least)
                side = np.flatnonzero(np.diff(first) != 0)
                split = int(side[0]) + 1 if len(side) else pair_bins
                step = np.zeros_like(grid)
                for rows in (slice(0, split), slice(split, pair_bins)):
                    if gg[rows].size:
                        step[rows] = _tree(gg[rows].sum(axis=0), hh[rows].sum(axis=0), 2, least)
                step *= rate
                grid += step
                total += step[spot[i], spot[j]]
        return AdditiveModel(base, cuts, tables, [(i, j, coarse[i], coarse[j], g) for (i, j), g in zip(chosen, grids, strict=True)])


def _feature_rows(docs: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """extra columns and the features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [[float(v) for v in features(t.as_py())] for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*extra, "x"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(*extra, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"{fields}, x array<double>")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_train: int = MAX_TRAIN,
) -> AdditiveModel:
    """Fits the model on the labelled rows that are not held out, max_train of them at most.

    Only the identifier and the label are read from labels. Rows with a null in either are passed over; a label that
    repeats counts each time. The rows chosen are those with the smallest hashes, so reruns agree.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("__label_id"), (F.col(label_col) > 0.5).cast("int").alias("__y"))
    some = known.orderBy(F.xxhash64("__label_id"), "__label_id", "__y").limit(max_train)
    rows = docs.select(id_col, text_col).join(F.broadcast(some), F.col(id_col) == F.col("__label_id"))  # max_train rows
    rows = rows.select("__y", F.xxhash64("__label_id").alias("__h"), text_col)
    # identifiers may repeat in docs as well: max_train rows reach the driver in any case
    got = _feature_rows(rows, id_col, text_col, ["__y", "__h"]).orderBy("__h", "__y", "x").limit(max_train).toArrow()
    y = got.column("__y").to_numpy().astype(np.float64) if got.num_rows else np.zeros(0)
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(got.num_rows, len(FEATURES))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)  # rows come in any order
    return AdditiveModel.fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, keep: bool = False) -> DataFrame:
    """id_col, held_out, score, predicted for each row of docs; with keep, instead the rows of docs that are accepted.

    A null text scores as an empty one. Rows that repeat get the same score; an empty table gives an empty result. Only
    the identifier and the text are read for a score; with keep, all columns come through, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            x = np.array([features(t.as_py()) for t in batch.column(batch.num_columns - 1)], dtype=np.float64)
            s = model.score(x.reshape(batch.num_rows, len(FEATURES)))
            if keep:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(s >= accept))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= accept).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    if keep:
        return docs.select("*", F.col(text_col).cast("string").alias("__text")).mapInArrow(run, docs.schema)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")
