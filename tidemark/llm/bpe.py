"""Operator 7: BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from struct import pack
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remembered, slices

# The byte alphabet of byte-level vocabularies - printable bytes stand for themselves, the others take
# the code points from 256 on in byte order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}

#: str.split() cuts at these controls, which the vocabulary's pattern doesn't take for white space.
ODD_SPACE = frozenset("\x1c\x1d\x1e\x1f")
#: Words, and chunks, that a Python worker remembers; beyond it forgets all of them.
REMEMBERED = 300_000


class Bpe:
    """A vocabulary file in the public tokenizer JSON form: NFC, white space runs to one space, lower case; a Split
    pattern whose matches are the words; byte-level symbols; merges with an end-of-word suffix; added special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        #: left id << 20 | right id -> rank; by rank the two ids and the merged one
        self.left, self.right, self.merged = ([ids[t] for t in side] for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.ranks = {a << 20 | b: rank for rank, (a, b) in enumerate(zip(self.left, self.right))}
        self.strings = {i: s for s, i in ids.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.strings |= {i: s for s, i in added.items()}
        self._special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this vocabulary's normaliser is not the supported NFC, white space, lower case")
        self._space = regex.compile(steps[1]["pattern"]["Regex"])
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self._word = regex.compile(split["pattern"]["Regex"])
        self._words: dict[str, tuple[bytes, str]] = {}
        self._chunks: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word.  Symbols form a doubly linked list; a heap holds rank and position of neighbours that can
        merge; an entry whose two symbols have changed since is stale and skipped."""
        text = [ALPHABET[b] for b in word.encode("utf-8")]
        text[-1] += self.suffix
        sym = [self.vocab.get(c, -1) for c in text]
        if -1 in sym:  # a symbol outside the vocabulary, with no unknown token, gives nothing
            sym = [s for s in sym if s >= 0]
        n = len(sym)
        rank, left, right, merged = self.ranks.get, self.left, self.right, self.merged
        heap = [r << 32 | k for k in range(n - 1) if (r := rank(sym[k] << 20 | sym[k + 1])) is not None]
        if not heap:
            return sym
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            k, r = top & 0xFFFFFFFF, top >> 32
            j = after[k]
            if sym[k] != left[r] or j >= n or sym[j] != right[r]:
                continue  # stale
            sym[k] = new = merged[r]
            sym[j] = -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := rank(new << 20 | sym[j])) is not None:
                    heappush(heap, r << 32 | k)
            if (i := before[k]) >= 0 and (r := rank(sym[i] << 20 | new)) is not None:
                heappush(heap, r << 32 | i)
        return [s for s in sym if s >= 0]

    def normal(self, text: str) -> str:
        text = self._space.sub(" ", normalize("NFC", text))
        # lower case by code point: the context rule for a final sigma is not applied
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def words(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Words of a text, or special tokens with their id."""
        for k, part in enumerate(self._special.split(text) if self._special and "<|" in text else (text,)):
            if k % 2:
                yield part, self.added[part]
            elif part:
                for w in self._word.findall(self.normal(part)):
                    yield w, None

    def word(self, word: str) -> tuple[bytes, str]:
        """A word's ids as little-endian 32-bit integers and its decoded text."""
        got = self._words.get(word)
        if got is None:
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            ids = self.merge(word)
            got = self._words[word] = (pack(f"<{len(ids)}I", *ids), self.decode(ids))
        return got

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same for text between white space; words never cross it, and no normalising step does."""
        got = self._chunks.get(chunk)
        if got is None:
            if len(self._chunks) >= REMEMBERED:
                self._chunks.clear()
            got = self._chunks[chunk] = self.join([self.word(w) if i is None else (pack("<I", i), w) for w, i in self.words(chunk)])
        return got

    @staticmethod
    def join(pairs: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return b"".join([a for a, _ in pairs]), " ".join([b for _, b in pairs if b])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text)[0], "<u4").tolist()

    def encode_bytes(self, text: str | None) -> tuple[bytes, str]:
        """All ids as bytes, and the decoded text; null is empty."""
        if not text:
            return b"", ""
        if ODD_SPACE.isdisjoint(text):
            known = self._chunks.get
            return self.join([known(c) or self.chunk(c) for c in text.split()])
        return self.join([self.word(w) if i is None else (pack("<I", i), w) for w, i in self.words(text)])

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings one after another; the file names no decoder, so one space stands between them."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


@remembered
def load(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return Bpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row, and with ids=True also input_ids and decoded.

    Whole texts are encoded; null and empty texts have no ids and decode to the empty text.  Ids may be null or
    repeated; extra columns are ignored; an empty table gives no rows.  path: the vocabulary file, readable on every
    executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "_text"):
                got = [bpe.encode_bytes(t) for t in part.column("_text").to_pylist()]
                columns = [
                    part.column("_id"),
                    pa.array([len(a) // 4 for a, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(a).hexdigest() for a, _ in got], pa.string()),
                    pa.array([hashlib.sha256(b.encode("utf-8")).hexdigest() for _, b in got], pa.string()),
                ]
                names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([b for _, b in got], pa.string())]
                    names += ["input_ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>, decoded string" * ids
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(lean(run, uses=load), schema).withColumnRenamed("_id", id_col)
