"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point, the same on every machine. An n-gram is bound
from its letters' vectors, permuted by their place and multiplied; a text bundles (adds up) the vectors of its n-grams;
a language's prototype bundles the unit-length vectors of its training texts. A text gets the language whose prototype
has the largest cosine with it.

Texts are handled many at a time: their n-grams are counted by one sort, those that many of the texts share are
multiplied with their vectors as one matrix product, the others are added text by text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import pieces

#: Length of the vectors.
DIMS = 2048
#: Letters in an n-gram.
NGRAM = 3
#: Texts, and letters, that are bundled together; a longer text is bundled alone.
TEXTS = 512
LETTERS = 1 << 21
#: An n-gram that one in so many texts has goes into the matrix product.
SHARED = 32
#: Columns of that product, and n-grams of one text, that are widened at a time.
WIDE = 4096
#: Letters whose vectors a worker keeps.
KEPT = 50_000
#: Unit vectors are bundled in whole multiples of 1 / GRAIN, so that the sum does not depend on its order.
GRAIN = 1 << 20
#: Languages that may be learned: their prototypes go to the driver and to every executor.
LANGUAGES = 4096
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Profiles:
    """Letters, n-grams and texts as vectors."""

    def __init__(self):
        self.is_letter = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
        self.letters: dict[int, np.ndarray] = {}
        self.rank = np.zeros(sys.maxunicode + 1, dtype=np.int64)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > KEPT:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMS, dtype=np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The letters of the texts; and for each text and each distinct n-gram of its words, in order: the text's
        number, the n-gram as a number (its letters' ranks are the digits), how often it occurs.

        What is not a letter parts words, and counts as one space before and after each.
        """
        lower = [t.lower() for t in texts]
        codes = np.frombuffer("".join(f" {t} " for t in lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(self.is_letter[codes], codes, 32)
        text = np.repeat(np.arange(len(lower)), [len(t) + 2 for t in lower])
        again = np.zeros(len(codes), dtype=bool)
        again[1:] = (codes[1:] == 32) & (codes[:-1] == 32) & (text[1:] == text[:-1])
        codes, text = codes[~again], text[~again]
        letters = np.unique(codes)
        self.rank[letters] = np.arange(len(letters))
        digit, base = self.rank[codes], len(letters)
        assert base**NGRAM * (len(lower) + 1) < 1 << 63, "too many letters"
        n = max(0, len(codes) - NGRAM + 1)
        gram = np.zeros(n, dtype=np.int64)
        for place in range(NGRAM):
            gram = gram * base + digit[place : place + n]
        whole = text[:n] == text[NGRAM - 1 : NGRAM - 1 + n]
        key = np.sort((text[:n] * base**NGRAM + gram)[whole])
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, count = key[head], np.diff(np.append(head, len(key)))
        return letters, key // base**NGRAM, key % base**NGRAM, count

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of texts, and which of them have a letter. Sums of whole numbers, so the order does not matter."""
        letters, text, gram, count = self.grams(texts)
        if not len(gram):
            return np.zeros((len(texts), DIMS), dtype=np.float32), np.zeros(len(texts), dtype=bool)
        exact = np.float32 if count.sum() < 1 << 24 else np.float64
        total = np.zeros((len(texts), DIMS), dtype=exact)
        single = np.stack([self.letter(c) for c in letters.tolist()])
        # the first letter of an n-gram is moved furthest
        moved = [np.roll(single, NGRAM - 1 - place, axis=1) for place in range(NGRAM)]

        def bound(grams: np.ndarray) -> np.ndarray:
            out = np.ones((len(grams), DIMS), dtype=np.int8)
            for place in range(NGRAM - 1, -1, -1):
                out *= moved[place][grams % len(letters)]
                grams = grams // len(letters)
            return out

        kinds, column = np.unique(gram, return_inverse=True)
        many = np.bincount(column) * SHARED >= len(texts)
        if len(texts) == 1:
            many[:] = False
        common = np.flatnonzero(many)
        place = np.cumsum(many) - 1
        dense = many[column]
        has = np.bincount(text, minlength=len(texts)) > 0
        for lo in range(0, len(common), WIDE):
            mine = dense & (place[column] >= lo) & (place[column] < lo + WIDE)
            counts = np.zeros((len(texts), min(WIDE, len(common) - lo)), dtype=exact)
            counts[text[mine], place[column[mine]] - lo] = count[mine]
            total += counts @ bound(kinds[common[lo : lo + WIDE]]).astype(exact)
        text, gram, count = text[~dense], gram[~dense], count[~dense].astype(exact)
        for lo in range(0, len(text), WIDE):
            block = bound(gram[lo : lo + WIDE]).astype(exact)
            some = text[lo : lo + WIDE]
            starts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(some)], strict=True):
                total[some[a]] += count[lo + a : lo + b] @ block[a:b]
        return total, has

    def units(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts after others: the numbers of those with a letter, and their vectors at unit length."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and hi - lo < TEXTS and (hi == lo or size + len(texts[hi] or "") <= LETTERS):
                size += len(texts[hi] or "")
                hi += 1
            total, has = self.vectors([t or "" for t in texts[lo:hi]])
            total = total[has]
            norm = np.sqrt(np.einsum("ij,ij->i", total, total, dtype=np.float64))
            yield lo + np.flatnonzero(has), total / np.where(norm > 0, norm, 1)[:, None]
            lo = hi


_PROFILES: list[Profiles] = []


def _profiles() -> Profiles:
    """One for each worker process."""
    if not _PROFILES:
        _PROFILES.append(Profiles())
    return _PROFILES[0]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language, at unit length, from all rows with a language and a letter.

    What reaches the driver is one vector for each language, whatever the number of texts; more than LANGUAGES of them
    are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = _profiles(), {}
        for batch in pieces(batches):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for rows, units in profiles.units(batch.column(1).to_pylist()):
                whole, names = np.rint(units * GRAIN), langs[rows]
                for lang in set(names.tolist()):
                    sums[lang] = sums.get(lang, 0) + whole[names == lang].sum(axis=0, dtype=np.float64).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    parts = rows.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("dim", "x"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "dim").agg(F.sum("x").alias("x")).toLocalIterator():
        if r["lang"] not in found and len(found) >= LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages in {lang_col}")
        found.setdefault(r["lang"], np.zeros(DIMS))[r["dim"]] = r["x"]
    return {lang: v / max(1e-300, float(np.linalg.norm(v))) for lang, v in sorted(found.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score for each row of docs; score is the cosine, 0 where it is negative.

    A null text, or one without a letter, is 'und' with score 0, and so is every text if nothing was learned. Ties go to
    the first language in code point order. Texts are read whole, however long; one of over LETTERS letters is bundled
    alone. Rows that repeat give rows that repeat; an empty table gives an empty result. Only the identifier and the text
    are read.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], dtype=np.float32).reshape(len(names), DIMS)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, (langs, proto) = _profiles(), shared.value
        for batch in pieces(batches):
            pred = np.full(batch.num_rows, UNKNOWN, dtype=object)
            score = np.zeros(batch.num_rows)
            for rows, units in profiles.units(batch.column(2).to_pylist()) if langs else ():
                cosine = units @ proto.T
                best = cosine.argmax(axis=1)
                pred[rows] = np.array(langs, dtype=object)[best]
                score[rows] = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text_"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out, and predicts all rows; see predict."""
    return predict(docs, learn(docs.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)
