"""Encoding whole texts with the tokenizers library, repeated stretches once per worker.

A text is cut where its pre-tokenizer always cuts, and each distinct stretch is encoded once per worker and looked up
afterwards: natural text repeats its words, so most of the library's work falls away while the ids stay the same.
Distinct stretches of a batch are found in Arrow's hash kernel; unseen ones are encoded many at a time as ready-cut
words. Texts with white space that the cut rule doesn't know, or with a special token's string, are encoded whole, so
that all ids are those of the library's own call with add_special_tokens=False.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# White space of the Unicode standard outside ASCII, and the four ASCII separators that only some engines count.
RARE_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(128) if chr(c).isalpha()]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2


def word_cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where the patterns of both byte-level vocabularies always start a match, whatever stands around them."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data), bool)
    before_word = np.zeros(len(data), bool)
    before_word[:-1] = blank[:-1] & ~blank[1:]
    before_word[ends - 1] = False
    cut |= before_word
    cut[1:] |= ~blank[1:] & blank[:-1] & (data[:-1] != 32)
    cut[1:] |= blank[1:] & ~blank[:-1]
    # A run of letters ends at ASCII punctuation; apostrophes are left alone, as contractions are matched with their letters.
    kind = _KIND[data]
    letter = kind == 1
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    mark = kind == 2
    cut[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & (kind[1:] == 1))
    cut[starts] = True
    return cut


class Encoder:
    """ids of whole texts; ``most`` bounds the distinct stretches remembered by a worker."""

    def __init__(self, tokenizer: str | Tokenizer, cuts: Callable = word_cuts, rare: str | None = RARE_SPACE, most: int = 800_000, threads: int = 1):
        # The library reads this once a process; a worker's first encoder decides.
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.tokenizer = Tokenizer.from_file(tokenizer) if isinstance(tokenizer, str) else tokenizer
        added = [re.escape(str(t)) for t in self.tokenizer.get_added_tokens_decoder().values()]
        whole = [*([rare] if rare else []), *(["(?i:" + "|".join(added) + ")"] if added else [])]
        self.cuts, self.rare, self.most = cuts, "|".join(whole) or None, most
        # Where case and white space say nothing, stretches that differ in them alone are one.
        spec = json.loads(self.tokenizer.to_str())
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.folds = "Lowercase" in kinds and split.get("behavior") == "Removed" and bool(split.get("invert"))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # ends[k]: where the ids of stretch k - 1 end
        self.n = 0

    def _learn(self, new: list[bytes]) -> None:
        flat, lengths = [], []
        for i in range(0, len(new), 40_000):
            # Groups of ready-cut words are encoded in parallel by the library's threads.
            groups = [[b.decode() for b in new[k : k + 5000]] for k in range(i, min(i + 40_000, len(new)), 5000)]
            for words, found in zip(groups, self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)):
                flat.append(np.array(found.ids, np.uint32))
                lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(words)))
        flat, lengths = np.concatenate(flat), np.concatenate(lengths)
        had = int(self.ends[self.n])
        while had + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(new) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[had : had + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(new)] = had + np.cumsum(lengths)
        self.place.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One uint32 array of ids for each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        rare = np.asarray(pc.match_substring_regex(texts, self.rare)) if self.rare else np.zeros(len(texts), bool)
        whole = np.flatnonzero(rare)
        for part, rows in _by_bytes(texts.take(pa.array(whole)), whole):
            for i, e in zip(rows, self.tokenizer.encode_batch(part.to_pylist(), add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        usual = np.flatnonzero(~rare)
        for part in _by_bytes(texts.take(pa.array(usual)), usual):
            self._cached(*part, out)
        return out

    def _cached(self, texts: pa.Array, rows: np.ndarray, out: list) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lengths = np.diff(offsets)
        rows, first = rows[lengths > 0], offsets[:-1][lengths > 0] - offsets[0]
        if not len(rows):
            return
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        last = np.append(first[1:], len(data))
        starts = np.flatnonzero(self.cuts(data, first, last))
        bounds = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.folds:
            distinct = [d.strip().lower() for d in distinct]
        new = [d for d in dict.fromkeys(distinct) if d not in self.place] if self.folds else [d for d in distinct if d not in self.place]
        if self.n + len(new) > self.most:
            self._forget()
            new = list(dict.fromkeys(distinct))
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        begin, size = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        at = total[np.append(np.searchsorted(starts, first), len(starts))]
        for row, a, b in zip(rows, at[:-1], at[1:]):
            out[row] = ids[a:b]


def _by_bytes(texts: pa.Array, rows: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Slices of about ``most`` bytes; a longer text is a slice of its own."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1]
    begin, base = 0, np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
        yield texts.slice(begin, stop - begin), rows[begin:stop]
        begin, base = stop, ends[stop - 1]


_held: dict[str, Encoder] = {}


def encoder(path: str, most: int = 800_000) -> Encoder:
    """The worker's encoder for a tokenizer file: loaded once for each Python process, with the bound that it is first asked with."""
    if path not in _held:
        _held[path] = Encoder(path, most=most)
    return _held[path]
