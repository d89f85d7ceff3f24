"""Byte-level BPE over padded numpy matrices.

Words (the pre-tokenizer's pieces) become rows of byte ids. Rows of similar length share a matrix; in each
round every row still open merges its leftmost pair of minimum rank, found by a vectorised hash-table
lookup, and the matrix is compacted: merged rows lose one column, finished rows leave.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import regex

#: Fixed value: the split pattern of the public byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_PAIR = np.int32(2**31 - 1)
LONG_ROW = 256


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Default place of a vocabulary file; operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for shift, b in enumerate(sorted(set(range(256)) - set(plain))):
        letters[chr(256 + shift)] = b
    return letters


class PairTable:
    """Open-addressing hash table from a pair of ids to its merge rank, probed with whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_PAIR, np.int32)
        keys = (left.astype(np.int64) << 20) | right
        ranks = np.arange(len(keys), dtype=np.int32)
        slots = self._slot(keys)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] == -1]
            self.keys[slots[first]] = keys[first]
            self.ranks[slots[first]] = ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, slots = keys[rest], ranks[rest], (slots[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs (flat int arrays); NO_PAIR for pairs that never merge or hold padding (-1)."""
        keys = (left.astype(np.int64) << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        found = self.keys[slots]
        ranks = np.where(found == keys, self.ranks[slots], NO_PAIR)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & self.mask
            found = self.keys[slots]
            hit = found == keys[open_]
            ranks[open_[hit]] = self.ranks[slots[hit]]
            more = ~hit & (found != -1)
            open_, slots = open_[more], slots[more]
        return ranks


class MatrixBpe:
    """Encoder for one vocabulary file of the ``tokenizers`` library's JSON form."""

    def __init__(self, path: str, cache_words: int = 200_000):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int32)
        right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte_ids = np.full(256, -1, np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.table = PairTable(left, right)
        self.split = regex.compile(SPLIT).findall
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    # -- words to ids -------------------------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        lengths = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (row numbers repeated by length, ids)
        lo = 0
        for hi in (2, 4, 6, 8, 12, 16, 24, 32, 64, LONG_ROW):
            rows = np.flatnonzero((sizes > lo) & (sizes <= hi))
            lo = hi
            for at in range(0, len(rows), 65_536):
                self._bucket(words, rows[at : at + 65_536], sizes, hi, lengths, parts)
        for row in np.flatnonzero(sizes > LONG_ROW):
            ids = self._long(words[row])
            lengths[row] = len(ids)
            parts.append((np.full(len(ids), row, np.int64), ids))
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        for rows, ids in parts:
            new = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.empty(0, bool)
            first = np.flatnonzero(new)
            within = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
            flat[starts[rows] + within] = ids
        return flat, lengths

    def _bucket(self, words, rows, sizes, width, lengths, parts) -> None:
        size = sizes[rows]
        raw = np.frombuffer(b"".join([words[r] for r in rows]), np.uint8)
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width)[None, :] < size[:, None]] = self.byte_ids[raw]
        ranks = self.table.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            done = best == NO_PAIR
            if done.any():
                out, number = ids[done], rows[done]
                real = out >= 0
                count = real.sum(1)
                lengths[number] = count
                parts.append((np.repeat(number, count), out[real]))
                keep = ~done
                ids, ranks, rows, at, best = ids[keep], ranks[keep], rows[keep], at[keep], best[keep]
                if not len(rows):
                    return
                line = np.arange(len(rows))
            width = ids.shape[1]
            ids[line, at] = self.merged[best]
            stay = np.ones(ids.shape, bool)
            stay[line, at + 1] = False
            ids = ids[stay].reshape(len(rows), width - 1)
            if width == 2:
                ranks = np.full((len(rows), 1), NO_PAIR, np.int32)
                continue
            stay = np.ones(ranks.shape, bool)
            stay[line, at] = False
            ranks = ranks[stay].reshape(len(rows), width - 2)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.table.look_up(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < width - 2)
            ranks[after, at[after]] = self.table.look_up(ids[after, at[after]], ids[after, at[after] + 1])

    def _long(self, word: bytes) -> np.ndarray:
        """One very long word: all occurrences of the minimum-rank pair merge in a round, left to right.

        A token made by a merge takes part only in later-ranked merges, so this equals one merge at a time.
        """
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        ranks = self.table.look_up(ids[:-1], ids[1:])
        while len(ids) > 1:
            best = ranks.min()
            if best == NO_PAIR:
                break
            hits = np.flatnonzero(ranks == best)
            if len(hits) > 1:  # of hits that overlap (runs of adjacent positions) every second one counts
                run = np.cumsum(np.r_[True, np.diff(hits) != 1])
                first = np.r_[0, np.flatnonzero(np.diff(run)) + 1]
                hits = hits[(hits - hits[first][run - 1]) % 2 == 0]
            ids = ids.copy()
            ids[hits] = self.merged[best]
            ids = np.delete(ids, hits + 1)
            where = hits - np.arange(len(hits))
            ranks = np.delete(ranks, hits[hits < len(ranks)])
            touched = np.unique(np.r_[where - 1, where])
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            ranks[touched] = self.table.look_up(ids[touched], ids[touched + 1])
        return ids

    # -- texts to ids -------------------------------------------------------------------------------------

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (one more entry than texts)."""
        if len(self.words) > self.cache_words:
            self._forget()  # the cache only saves work; results don't depend on it
        words, split = self.words, self.split
        known = len(words)
        numbers: list[int] = []
        ends = [0]
        fresh: list[str] = []
        for text in texts:
            if text:
                for piece in split(text):
                    n = words.get(piece)
                    if n is None:
                        n = words[piece] = known + len(fresh)
                        fresh.append(piece)
                    numbers.append(n)
            ends.append(len(numbers))
        if fresh:
            ids, lengths = self.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.starts = np.r_[self.starts, np.cumsum(lengths) - lengths + len(self.pool)]
            self.pool = np.r_[self.pool, ids]
            self.lengths = np.r_[self.lengths, lengths]
        index = np.array(numbers, np.int64)
        size = self.lengths[index]
        total = np.r_[0, np.cumsum(size)]
        flat = self.pool[np.repeat(self.starts[index] - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.array(ends, np.int64)]
