"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A pre-token is encoded left to right with the longest token that starts at each place (all matches come from one
Aho-Corasick pass). A token may follow another only if the pair is compatible: merging the concatenation of both from
scratch has to give back exactly these two tokens. When no token fits, the walk steps back one token and takes the next
shorter one there; a place found to be a dead end is never tried again, so the work is linear in the length. The result
is the same as that of applying the merges in order.

Decoding gathers bytes from one blob with the ids' offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.llm.common import pieces

#: Pre-tokens whose ids a worker remembers; when the memory is full it starts anew, which costs time only.
CACHE = 200_000
#: Pairs of tokens whose compatibility it remembers.
PAIRS = 600_000

#: The byte-level pre-tokenizer's pattern, as the public vocabulary's description gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Compatibility:
    """Whether two tokens may stand side by side; tokens are numbered by merge order, single bytes first."""

    def __init__(self, halves: list[tuple[int, int]], merged: dict[tuple[int, int], int]):
        self.halves, self.merged, self.known = halves, merged, {}

    def __call__(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[key] = self._check(left, right)
        return found

    def _check(self, left: int, right: int) -> bool:
        """Undoes the later of the two tokens' last merges again and again: at no point may a merge across the
        border come before the merge that was undone last."""
        until = len(self.halves) + 1
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < until:
                return False
            later_left = left > right
            token = left if later_left else right
            halves = self.halves[token]
            if halves is None:  # both are single bytes, or the later one can't be undone
                token = right if later_left else left
                halves, later_left = self.halves[token], not later_left
                if halves is None:
                    return True
            # a border merge of the same rank as the right token's own merge would come first, being further left
            until = token if later_left else token + 1
            if later_left:
                left = halves[1]
            else:
                right = halves[0]


class ByteBPE:
    """A byte-level BPE vocabulary in the public JSON form, with encoder and decoder."""

    def __init__(self, spec: str):
        import ahocorasick

        data = json.loads(spec)
        letters, vocab = byte_letters(), data["model"]["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        raw = lambda token: bytes(letters[c] for c in token)
        strings = [bytes([b]) for b in range(256)]
        number = {s: k for k, s in enumerate(strings)}
        ids = [vocab[c] for c, b in sorted(letters.items(), key=lambda x: x[1])]
        halves: list = [None] * 256
        merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = raw(a), raw(b)
            pair, whole = (number[left], number[right]), left + right
            if whole in number:
                merged.setdefault(pair, number[whole])
                continue
            number[whole] = merged[pair] = len(strings)
            strings.append(whole)
            halves.append(pair)
            ids.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.sizes = [len(s) for s in strings]
        self.shorter = [self._prefix(s, number) for s in strings]
        self.fits = Compatibility(halves, merged)
        self.automaton = ahocorasick.Automaton()
        for k, s in enumerate(strings):
            self.automaton.add_word(s.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.ids = np.array(ids, dtype="<u4")
        self._table({i: s for i, s in zip(ids, strings, strict=True)} | {i: t.encode() for t, i in self.special.items()})
        self._compile()
        self.cache = _Cache(self)

    @staticmethod
    def _prefix(token: bytes, number: dict[bytes, int]) -> int:
        """The longest shorter token that token starts with, or -1."""
        return next((number[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in number), -1)

    def _table(self, strings: dict[int, bytes]) -> None:
        """The blob of all tokens' bytes in id order, and where each begins."""
        size = max(strings) + 1
        ordered = [strings.get(i, b"") for i in range(size)]
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(s) for s in ordered], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(ordered), dtype=np.uint8)

    def _compile(self) -> None:
        import regex

        self.findall = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens, numbered by merge order, of one pre-token."""
        n, sizes = len(piece), self.sizes
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - sizes[token]
            if longest[start] < 0 or sizes[token] > sizes[longest[start]]:
                longest[start] = token
        out: list[int] = []
        open_end = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and not (open_end[at + sizes[token]] and (not out or self.fits(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at] if at < n else -1
            else:
                open_end[at] = 0
                token = out.pop()
                at -= sizes[token]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of text, as little-endian unsigned 32-bit integers."""
        cache, findall = self.cache, self.findall
        if self.cut is None or not self.cut.search(text):
            return b"".join([cache[w] for w in findall(text)])
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [cache[w] for w in findall(text[at : m.start()])]
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join(out + [cache[w] for w in findall(text[at:])])

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; ids as encode_bytes gives them."""
        numbers = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(numbers):
            return b""
        begin = self.offsets[numbers]
        size = self.offsets[numbers + 1] - begin
        ends = np.cumsum(size)
        return self.blob[np.repeat(begin - ends + size, size) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Cache(dict):
    """Ids of pre-tokens met before, as bytes."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        value = self.bpe.ids[self.bpe.encode_piece(word.encode("utf-8"))].tobytes()
        if len(word) <= 64:
            self[word] = value
        return value


_LOADED: dict[int, ByteBPE] = {}


def _load(spec: str) -> ByteBPE:
    """One encoder for each vocabulary and worker process."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(spec)
    return _LOADED[key]


def _spec(spark: SparkSession, tokenizer: str):
    """The vocabulary file, read on the driver and broadcast: its size (2 MB) does not depend on the data."""
    with open(tokenizer, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, ids (little-endian uint32 binary) and decoded text.

    A null text counts as empty: no ids, empty decoded text. Special tokens of the vocabulary that occur in a text
    become their own ids, as the public library does with add_special_tokens=False. Rows that repeat give rows that
    repeat; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    spec = _spec(spark, tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(spec.value)
        for part in pieces(batches, rows=256, size=4 << 20):
            ids = [bpe.encode_bytes(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([bpe.decode(x) for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    schema = f"`{id_col}` {id_type}, n_tokens long, ids binary, decoded string"
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
