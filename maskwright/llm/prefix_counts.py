"""Token counts of every prefix of a text, exactly: truncation and budget questions without encoding again.

A text falls into pieces that its tokenizer never joins; the count of a prefix is the sum over the pieces before its last one, plus the
count of that piece's beginning. Within a piece a dynamic programme runs over its places. The byte-pair encoding of a beginning is
that of a shorter one and one more token; exactly one token of the vocabulary that ends there fits, which is to say that undoing its
merges and those of the token before it shows no merge across their border that would have come first. So

    count(i) = count(i - len(t)) + 1        for the token t that ends at i and fits the token before it,

once for places inside a word and once, with tokens that carry the word-end mark, for a text that ends there. Counts need not grow:
a longer beginning can have fewer tokens. Pieces are worked out once a worker and looked up afterwards.

For tokenizers of the kind "byte-pair merges with a word-end mark, white space dropped" (``ValueError`` for others): the normaliser and
the splitting into pieces are the library's own. A prefix of ``n`` is the text's first n code points. Positions inside a
group of characters that normalise to another are counted as that shorter text by itself; special tokens' strings are one token once they are
whole, and ordinary text before. One text in ``CHECKED`` is compared with the library's own count as it runs; a difference raises.

Defined results: null texts are empty and have no tokens; repeated rows are counted each; very long texts are counted whole; null ids and
other columns pass through, those named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from maskwright.llm.runtime import add_columns
from maskwright.llm.tokens import RARE_SPACE, _by_bytes, word_cuts

CHECKED = 64
NEVER = 1 << 60
# Letters that no neighbour among them changes, and that normalise one by one.
SIMPLE = re.compile(r"[ \t\n\x0b\x0c\r]*([A-Za-zÀ-ÖØ-öø-ÿ]*)")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = itertools.count(256)
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


TAIL = 4


def _reach(tokens: dict[str, int]) -> dict[str, int]:
    """By the last ``TAIL`` symbols of a place, the length of the longest token that may end there; shorter ones where none is named."""
    out: dict[str, int] = {}
    for t in tokens:
        if len(t) >= TAIL:
            out[t[-TAIL:]] = max(out.get(t[-TAIL:], 0), len(t))
    return out


class Merges:
    """The dynamic programme over one vocabulary of ranked merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], mark: str):
        self.rank: dict[tuple[int, int], int] = {}
        top = max(vocabulary.values(), default=0) + 1
        self.made, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        for rank, (a, b) in enumerate(merges):
            x, y, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = rank, x, y
            self.rank.setdefault((x, y), rank)
        if any(max(self.made[x], self.made[y]) >= rank for (x, y), rank in self.rank.items()):
            raise ValueError("a merge comes before those of its parts")
        self._fits: dict[int, bool] = {}
        self._done, self._last, self._count, self._out = "", [0], [0], []
        reached = [False] * top
        for t in sorted(range(top), key=self.made.__getitem__):
            a, b = self.left[t], self.right[t]
            reached[t] = a < 0 or (reached[a] and reached[b] and self._apart(a, b, first=False))
        reachable = {s: t for s, t in vocabulary.items() if reached[t]}
        self.inner = {s: t for s, t in reachable.items() if not s.endswith(mark)}
        self.final = {s[: -len(mark)]: t for s, t in reachable.items() if s.endswith(mark) and s != mark}
        self._inner_reach, self._final_reach = _reach(self.inner), _reach(self.final)

    def _apart(self, a: int, b: int, first: bool = True) -> bool:
        """Whether the text of a and b is encoded as a, b: no merge over their border comes before those that made both.

        Merges are undone, the latest first; among equal ones the library takes the leftmost first. ``first`` False leaves the merge of a and b themselves out.
        """
        above_a = above_b = NEVER
        while True:
            over = self.rank.get((a, b), NEVER) if first else NEVER
            if over < above_a and over <= above_b and over != NEVER:
                return False
            first = True
            if self.made[a] < 0 and self.made[b] < 0:
                return True
            if self.made[a] > self.made[b]:
                above_a, a = self.made[a], self.right[a]
            else:
                above_b, b = self.made[b], self.left[b]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._apart(a, b)
        return known

    def counts(self, word: str) -> list[int]:
        """For each beginning of ``word`` (byte symbols), the tokens of a text that ends there.

        What the word shares with the one before it is not worked out again: callers sort words.
        """
        shared = len(os.path.commonprefix((self._done, word)))
        inner, final, fits, inner_reach, final_reach = self.inner, self.final, self.fits, self._inner_reach, self._final_reach
        last, count, out = self._last[: shared + 1], self._count[: shared + 1], self._out[:shared]
        for i in range(shared + 1, len(word) + 1):
            tail = word[i - TAIL : i] if i >= TAIL else ""
            for j in range(max(0, i - inner_reach.get(tail, TAIL - 1)), i):
                t = inner.get(word[j:i])
                if t is not None and (j == 0 or fits(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("no token fits")
            for j in range(max(0, i - final_reach.get(tail, TAIL - 1)), i):
                t = final.get(word[j:i])
                if t is not None and (j == 0 or fits(last[j], t)):
                    out.append(count[j] + 1)
                    break
            else:
                raise ValueError("no token fits")
        self._done, self._last, self._count, self._out = word, last, count, out
        return out


class PrefixCounter:
    """Prefix counts of whole texts; ``most`` bounds the stretches that a worker remembers, ``most_places`` their places."""

    def __init__(self, path: str, most: int = 800_000, most_places: int = 16_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model.get("end_of_word_suffix")
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")]
        split, *_, level = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        dropped = split.get("behavior") == "Removed" and split.get("invert") and level.get("type") == "ByteLevel" and not level.get("use_regex") and not level.get("add_prefix_space")
        if model["type"] != "BPE" or not mark or any(odd) or not dropped or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not byte-pair merges with a word-end mark over pieces without white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]], mark)
        self.symbols = _byte_symbols()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.rare = "|".join([RARE_SPACE, *(["(?i:" + "|".join(map(re.escape, special)) + ")"] if special else [])])
        self.most, self.most_places = most, most_places
        self._one: dict[str, str] = {}
        self._words: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.ends, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def _symbols(self, text: str) -> str:
        return "".join([self.symbols[b] for b in text.encode()])

    def _word(self, word: str) -> list[int]:
        found = self._words.get(word)
        if found is None:
            found = self.merges.counts(word)
            if len(word) <= 64:
                if len(self._words) > 100_000:
                    self._words.clear()
                self._words[word] = found
        return found

    def _normal(self, text: str) -> str:
        if len(text) > 1:
            return self.tokenizer.normalizer.normalize_str(text)
        if text not in self._one:
            self._one[text] = self.tokenizer.normalizer.normalize_str(text)
        return self._one[text]

    def _stretch(self, text: str) -> list[int]:
        """Counts of the text's beginnings, one for each code point."""
        simple = SIMPLE.fullmatch(text)
        if not simple:
            return self._pieces(text)
        word = simple[1].lower()
        if word.isascii():
            inside = self.merges.counts(word)
        else:
            at = np.cumsum([1 if c < "\x80" else 2 for c in word]) - 1
            found = self.merges.counts(self._symbols(word))
            inside = [found[k] for k in at]
        return [0] * (len(text) - len(word)) + inside

    def _ends(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """(counts of the beginnings of a normalised text, the bounds of its pieces)."""
        counts, base, bounds = [0] * len(text), 0, []
        at = 0
        for word, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            counts[at:a] = [base] * (a - at)
            piece = text[a:b]
            found, place, inside = self._word(word), -1, []
            for c in piece:
                place += 1 if c < "\x80" else len(c.encode())
                inside.append(found[place])
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
                # A contraction is one piece once it is whole; before, its apostrophe and letter are two.
                inside[:-1] = [self._word("'")[0] + (self._word(piece[1:k])[-1] if k > 1 else 0) for k in range(1, len(piece))]
            counts[a:b] = [base + n for n in inside]
            bounds.append((a, base))
            base, at = base + inside[-1], b
        counts[at:] = [base] * (len(text) - at)
        return counts, bounds

    def _pieces(self, text: str) -> list[int]:
        """The same for any text without special tokens: groups of characters that normalise together are taken apart."""
        parts, ends, partial = [], [], []  # partial: (place, normal text before the group, its beginning's normal text)
        place = 0
        for group in _groups(text):
            if len(group) == 1 or unicodedata.is_normalized("NFC", group):
                for c in group:
                    parts.append(self._normal(c))
                    place += len(parts[-1])
                    ends.append(place)
                continue
            for k in range(1, len(group)):
                partial.append((len(ends), place, self._normal(group[:k])))
                ends.append(0)
            parts.append(self._normal(group))
            place += len(parts[-1])
            ends.append(place)
        normal = "".join(parts)
        counts, bounds = self._ends(normal)
        upto = [0, *counts]
        out = [upto[e] for e in ends]
        starts = [a for a, _ in bounds]
        for at, place, begun in partial:
            # The last piece that begins before the group, and what the group's beginning adds to it.
            k = int(np.searchsorted(starts, place, "left")) - 1
            a, base = bounds[k] if k >= 0 else (0, 0)
            out[at] = base + len(self.tokenizer.encode(normal[a:place] + begun, add_special_tokens=False).ids)
        return out

    def _whole(self, text: str) -> np.ndarray:
        """Prefix counts of a text that may hold special tokens."""
        out, base, at = [0], 0, 0
        for found in self.special.finditer(text) if self.special else ():
            inside = self._pieces(text[at : found.end() - 1])
            before = inside[found.start() - at - 1] if found.start() > at else 0
            out += [base + n for n in inside] + [base + before + 1]
            base, at = base + before + 1, found.end()
        return np.array(out + [base + n for n in self._pieces(text[at:])], np.int32)

    def counts(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text the counts of its prefixes, of 0 up to all code points; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray] = [np.zeros(1, np.int32)] * len(texts)
        rare = np.asarray(pc.match_substring_regex(texts, self.rare))
        for i in np.flatnonzero(rare):
            out[i] = self._whole(texts[i].as_py())
        usual = np.flatnonzero(~rare)
        for part in _by_bytes(texts.take(pa.array(usual)), usual):
            self._looked_up(*part, out)
        return out

    def _learn(self, new: list[bytes]) -> None:
        new.sort(key=lambda b: b.strip().lower())
        found = [self._stretch(b.decode()) for b in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        had = int(self.ends[self.n])
        while had + sizes.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(new) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[had : had + int(sizes.sum())] = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        self.ends[self.n + 1 : self.n + 1 + len(new)] = had + np.cumsum(sizes)
        self.place.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)

    def _looked_up(self, texts: pa.Array, rows: np.ndarray, out: list) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lengths = np.diff(offsets)
        rows, first = rows[lengths > 0], offsets[:-1][lengths > 0] - offsets[0]
        if not len(rows):
            return
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = np.flatnonzero(word_cuts(data, first, np.append(first[1:], len(data))))
        stretches = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = stretches.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.n + len(distinct) > self.most or self.ends[self.n] > self.most_places:
            self._forget()
        if new := [d for d in distinct if d not in self.place]:
            self._learn(new)
        slot = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        begin, size = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        inside = self.flat[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        tokens = np.concatenate([[0], np.cumsum(self.flat[self.ends[slot + 1] - 1])])
        text = np.searchsorted(starts, first)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(text, len(starts))))
        inside = inside + np.repeat(tokens[:-1] - tokens[text][of], size).astype(np.int32)
        at = upto[np.append(text, len(starts))]
        for row, a, b in zip(rows, at[:-1], at[1:]):
            out[row] = np.concatenate([np.zeros(1, np.int32), inside[a:b]])

    def check(self, texts: list[str], counts: list[int]) -> None:
        if [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] != counts:
            raise RuntimeError("token counts differ from the library's")


def _groups(text: str):
    """Runs of a character and what may join it: marks, and the vowels and finals of Korean syllables."""
    start = 0
    for k in range(1, len(text) + 1):
        if k == len(text) or text[k] < "̀" or not (unicodedata.category(text[k])[0] == "M" or "ᅠ" <= text[k] <= "ᇿ"):
            yield text[start:k]
            start = k


_held: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a tokenizer file: loaded once for each Python process."""
    if path not in _held:
        _held[path] = PrefixCounter(path)
    return _held[path]


def pack_steps(counts: np.ndarray) -> bytes:
    """Prefix counts as differences between neighbours, after one byte that tells their width."""
    steps = np.diff(counts)
    most = int(np.abs(steps).max(initial=0))
    width = 1 if most < 128 else 2 if most < 1 << 15 else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpack_steps(raw: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, f"<i{raw[0]}", offset=1), dtype=np.int64)])


def within(counts: np.ndarray, budget: int) -> int:
    """The longest prefix of at most ``budget`` tokens."""
    return len(counts) - 1 if counts[-1] <= budget else int(np.flatnonzero(counts <= budget)[-1])


def add_prefix_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", budget: int | None = None, keep: bool = True) -> DataFrame:
    """``docs`` with n_tokens, with kept_chars (the longest prefix within ``budget`` tokens, if given) and, with ``keep``, prefix_steps for ``cut`` and ``tokens_at``."""
    fields = [("n_tokens", T.LongType()), *([("kept_chars", T.LongType())] if budget is not None else []), *([("prefix_steps", T.BinaryType())] if keep else [])]

    def compute(texts: pa.Array) -> list:
        own = counter(tokenizer)
        counts = own.counts(texts)
        looked = [(t, int(c[-1])) for t, c in zip(texts.to_pylist(), counts) if t and zlib.crc32(t.encode()) % CHECKED == 0]
        own.check([t for t, _ in looked], [n for _, n in looked])
        found = {"n_tokens": [int(c[-1]) for c in counts]}
        if budget is not None:
            found["kept_chars"] = [within(c, budget) for c in counts]
        if keep:
            found["prefix_steps"] = [pack_steps(c) for c in counts]
        return [found[name] for name, _ in fields]

    return add_columns(docs, text_col, [T.StructField(name, kind) for name, kind in fields], compute, max_rows=256)


def cut(counted: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """``counted`` with ``truncated``: its texts' longest prefixes of at most ``budget`` tokens, from the stored counts alone."""

    @F.udf("long", useArrow=True)
    def longest(raw: bytes) -> int:
        return within(unpack_steps(raw), budget)

    return counted.withColumn("truncated", F.substring(F.coalesce(text_col, F.lit("")), F.lit(1), longest("prefix_steps").cast("int")))


def tokens_at(counted: DataFrame, places: str) -> DataFrame:
    """``counted`` with ``tokens_at``: the count of the prefix of as many code points as column ``places`` says (null outside the text)."""

    @F.udf("long", useArrow=True)
    def at(raw: bytes, place: int) -> int | None:
        counts = unpack_steps(raw)
        return int(counts[place]) if place is not None and 0 <= place < len(counts) else None

    return counted.withColumn("tokens_at", at("prefix_steps", places))
