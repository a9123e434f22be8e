"""A byte-level vocabulary over the distinct white-space-led chunks of many texts, in numpy.

Without a normaliser such a vocabulary never lets a token span from a non-space to a space, so a text's ids are the ids
of its chunks `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]*` one after another.  The tokenizers library encodes each new chunk,
some thousands end to end: the byte lengths of the tokens tell where a chunk's ids end.  Chunks are found by hash and
compared byte by byte.  Texts where a space beyond ASCII stands before an ASCII one or at the end are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8
from .textkernel import SPACE, U64, span_hashes

#: Chunks whose ids a Python worker remembers, some 50 bytes each; beyond it forgets all of them.
REMEMBERED = 2_000_000
#: Bytes of text looked at together, and new chunks encoded end to end.
PIECE = 1 << 20
JOINED = 4_000
_ODD = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]([\x09-\x0D\x20]|\z)"


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of many spans, end to end."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class _Pool:
    """Spans end to end in one growing array."""

    def __init__(self, dtype: np.dtype) -> None:
        self.data, self.used = np.empty(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> int:
        if self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.empty(self.used + 2 * len(values), self.data.dtype)])
        at, self.used = self.used, self.used + len(values)
        self.data[at : self.used] = values
        return at


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        pre, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder()
        plain = not any(t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in added.values())
        self.chunked = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and plain
        self.width = np.zeros(size, np.int64)  # bytes of each token: one for each letter of the byte alphabet
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[k] = len(added[k].content.encode()) if k in added else len(token)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, U64), np.zeros(0, np.int32)
        self.ids, self.bytes = _Pool(self.dtype), _Pool(np.dtype(np.uint8))
        self.facts = np.zeros((0, 4), np.int64)  # by slot: first id, number of ids, first byte, number of bytes

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, raw: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of chunks that begin with a space and end without, and how many each has; None if a token spans two."""
        ids = self.whole([raw.decode()])[0]
        token_end, end = np.cumsum(self.width[ids]), np.cumsum(size)
        at = np.searchsorted(token_end, end)
        if not len(ids) or at[-1] >= len(ids) or (token_end[at] != end).any():
            return None
        return ids, np.diff(np.concatenate(([0], at + 1)))

    def _learn(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Encode new chunks (h: distinct and ascending) and remember them."""
        if len(self.hashes) + len(h) > REMEMBERED:
            self.forget()
        led = SPACE[data[start]] & ~SPACE[data[start + size - 1]]
        order = np.concatenate((np.flatnonzero(led), np.flatnonzero(~led)))
        n_led = int(led.sum())
        start, size = start[order], size[order]
        ids, count = [], []
        for k in range(0, len(order), JOINED):
            k_end = min(k + JOINED, n_led) if k < n_led else k + JOINED
            for lo, hi in ((k, k_end), (k_end, k + JOINED)) if k < n_led else ((k, k_end),):
                s = size[lo:hi]
                if not len(s):
                    continue
                raw = gathered(data, start[lo:hi], s).tobytes()
                got = self._joined(raw, s) if lo < n_led else None
                if got is None:
                    edge = np.concatenate(([0], np.cumsum(s))).tolist()
                    each = self.whole([raw[a:b].decode() for a, b in zip(edge, edge[1:])])
                    got = np.concatenate(each), np.array([len(e) for e in each])
                ids.append(got[0])
                count.append(got[1])
        count = np.concatenate(count).astype(np.int64)
        first = self.ids.add(np.concatenate(ids)) + np.cumsum(count) - count
        byte = self.bytes.add(gathered(data, start, size)) + np.cumsum(size) - size
        slot = np.empty(len(order), np.int32)
        slot[order] = len(self.facts) + np.arange(len(order))
        self.facts = np.concatenate([self.facts, np.stack([first, count, byte, size], axis=1)])
        at = np.searchsorted(self.hashes, h)
        self.hashes, self.slots = np.insert(self.hashes, at, h), np.insert(self.slots, at, slot)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def _piece(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of ids of each chunk) of chunks that fill data; None if two chunks share a hash."""
        end = np.append(start[1:], len(data))
        size = end - start
        kinds, one, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        _, known = self._find(kinds)
        if not known.all():
            self._learn(data, kinds[~known], start[one[~known]], size[one[~known]])
            if not self._find(kinds)[1].all():  # it forgot the others
                self._learn(data, kinds[known], start[one[known]], size[one[known]])
        fact = self.facts[self.slots[self._find(kinds)[0]]]
        alike = (fact[which, 3] == size).all() and (gathered(self.bytes.data, fact[:, 2], fact[:, 3]) == gathered(data, start[one], size[one])).all() and (gathered(data, start[one[which]], size) == data).all()
        if not alike:
            return None
        return gathered(self.ids.data, fact[which, 0], fact[which, 1]), fact[which, 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has (null: none)."""
        rows = len(texts)
        data, at = utf8(texts)
        count = np.zeros(rows, np.int64)
        odd = np.ones(rows, bool)
        if self.chunked:
            odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = []
        lo = 0
        for k in [*np.flatnonzero(odd).tolist(), rows]:
            if k > lo:  # the rows lo to k go by chunks
                ids, count[lo:k] = self._rows(data[at[lo] : at[k]], at[lo : k + 1] - at[lo])
                out.append(ids)
            if k < rows:
                out.append(self.whole([data[at[k] : at[k + 1]].tobytes().decode()])[0])
                count[k] = len(out[-1])
            lo = k + 1
        return np.concatenate(out) if out else np.zeros(0, self.dtype), count

    def _rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.zeros(len(at) - 1, np.int64)
        if not len(data):
            return np.zeros(0, self.dtype), count
        space = SPACE[data]
        first = np.zeros(len(data), bool)
        first[1:] = space[1:] & ~space[:-1]
        first[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(first)
        out = []
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + PIECE)))
            stop = int(start[hi]) if hi < len(start) else len(data)
            row = np.searchsorted(at, start[lo:hi], side="right") - 1
            got = self._piece(data[start[lo] : stop], start[lo:hi] - start[lo])
            if got is None:  # each chunk by itself
                edge = [*start[lo:hi].tolist(), stop]
                each = self.whole([data[a:b].tobytes().decode() for a, b in zip(edge, edge[1:])])
                got = np.concatenate(each), np.array([len(e) for e in each])
            out.append(got[0])
            count += np.bincount(row, weights=got[1], minlength=len(count)).astype(np.int64)
            lo = hi
        return np.concatenate(out), count


@cache
def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker."""
    return ChunkEncoder(path)
