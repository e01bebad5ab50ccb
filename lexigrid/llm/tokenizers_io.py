"""Ids of a ``tokenizers`` file, by the library itself and by equal faster ways.

``Ids`` gives the ids that ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``
gives: strings of the file's added tokens that stand in a text become those tokens, as the
library does by default. With ``special="text"`` they are ordinary text (the library's
``encode_special_tokens``). Two shortcuts serve texts of plain Latin characters (below
U+0250, without control characters that are white space in only one of the libraries) that
hold no such string; all other texts go through ``tokenizers`` whole:

* a byte-level file without a normalizer is encoded by ``tiktoken`` with the same merges;
* a file that drops white space is encoded word by word: a word between white space has
  the same ids wherever it stands, so words are remembered, about ``REMEMBERED`` at most,
  and found again by all of their bytes. Characters below U+0250 have no other composed
  form, and are lower-cased alike by both.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

REMEMBERED = 1 << 20
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0İɐ-\U0010ffff]")
#: Fixed value: how byte-level files of this kind split a text before merging.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level files: printable bytes stand for themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def ids_of(path: str, special: str = "tokens") -> Ids:
    """The encoder of a file, kept by the worker process from task to task."""
    return Ids(path, special)


class Ids:
    """Encoder of one file."""

    def __init__(self, path: str, special: str = "tokens") -> None:
        if special not in ("tokens", "text"):
            raise ValueError("special strings are 'tokens' or 'text'")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special == "text"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t for t in spec["added_tokens"] if special == "tokens" or not t["special"]]
        # Lower case too: a token may be looked for in the text that the normalizer made.
        self.folded = any(t["normalized"] for t in added)
        self.added = sorted({t["content"] for t in added} | {t["content"].lower() for t in added if t["normalized"]})
        self.fast = self._ranked(spec) if not spec["normalizer"] and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] else None
        self.words: WordTable | None = None
        if spec["model"].get("end_of_word_suffix") and self._drops_space(spec):
            self.words = WordTable()
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.split = regex.compile(pattern)
            self.split_lines = regex.compile(f"(?:{pattern})|\n")
            self.letters = {b: letter for letter, b in _byte_letters().items()}
            self.ends, self.line_end = self._with_ends(spec), spec["model"]["vocab"].get(self.letters[ord("\n")])

    @staticmethod
    def _with_ends(spec: dict) -> tiktoken.CoreBPE | None:
        """The same merges on bytes, with a zero byte for a word's end; lines' ends stand alone.

        Holds for files whose ids are bytes, bytes at an end, then merges in their order;
        texts with a zero byte don't come here.
        """
        letters, vocab, end = _byte_letters(), spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        joined = [a + b for a, b in merges]
        if any(vocab[t] != 512 + i for i, t in enumerate(joined)) or any(vocab[c] > 255 or not 255 < vocab[c + end] < 512 for c in letters):
            return None

        def raw(token: str) -> bytes:
            body, tail = (token[: -len(end)], b"\0") if token.endswith(end) else (token, b"")
            return bytes(letters[c] for c in body) + tail

        ranks = {raw(t): vocab[t] for c in letters for t in (c, c + end)} | {raw(t): 512 + i for i, t in enumerate(joined)}
        return tiktoken.Encoding("ends", pat_str="\n|[^\n\0]+\0", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        """Composed, white space made one space, lower-cased; matches split off, then bytes as letters."""
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
        return (
            normal == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in split] == ["Split", "ByteLevel"]
            and split[0]["behavior"] == "Removed"
            and split[0]["invert"]
            and "Regex" in split[0]["pattern"]
            and not split[1]["add_prefix_space"]
        )

    @staticmethod
    def _ranked(spec: dict) -> tiktoken.Encoding | None:
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("same", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit arrays."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if (self.fast or self.words is not None) and not self._needs_library(t)]
        if self.fast:
            for i in plain:
                out[i] = np.array(self.fast.encode_ordinary(texts[i]), np.uint32)
        elif plain:
            for i, ids in zip(plain, self._by_words([texts[i] for i in plain]), strict=True):
                out[i] = ids
        odd = [i for i, ids in enumerate(out) if ids is None]
        for i, made in zip(odd, self.library.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(made.ids, np.uint32)
        return out

    def _needs_library(self, text: str) -> bool:
        return bool(_ODD.search(text)) or any(s in text for s in self.added) or (self.folded and any(s in text.lower() for s in self.added))

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        blobs = [t.lower().encode() for t in texts]
        blob = b"\n".join(blobs) + b"\n"
        begins, ends = word_spans(blob)
        if self.words.n > REMEMBERED:
            self.words.clear()
        slots = self.words.entries(blob, begins, ends, self._ids_of_words)
        ids, sizes = self.words.ids(slots)
        limits = np.cumsum([len(b) + 1 for b in blobs])
        stops = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(begins, limits)]
        return np.split(ids, stops[:-1])

    def _ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has); words are lines to the library's parts."""
        if not self.ends:
            made = [self._ids_of(word) for word in words]
            counts = np.fromiter(map(len, made), np.int64, len(made))
            return np.fromiter((i for ids in made for i in ids), np.uint32, int(counts.sum())), counts
        parts = self.split_lines.findall("\n".join(words) + "\n")
        ids = np.array(self.ends.encode_ordinary(("\0".join(parts) + "\0").replace("\n\0", "\n")), np.uint32)
        lines = ids == self.line_end
        return ids[~lines], np.diff(np.flatnonzero(lines), prepend=-1) - 1

    def _ids_of(self, word: str) -> list[int]:
        parts = (part.encode().decode("latin-1").translate(self.letters) for part in self.split.findall(word))
        return [t.id for part in parts for t in self.library.model.tokenize(part)]


_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_U = np.uint64
#: Bytes of a word that its key holds; longer words are found in a dictionary.
_KEY = 16
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def word_spans(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each word of a blob that ends in white space."""
    space = _IS_SPACE[np.frombuffer(blob, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def word_keys(blob: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each word, as two numbers; words have no zero byte."""
    at_each = np.ndarray((len(blob) + 8,), "<u8", blob + bytes(_KEY), 0, (1,))  # the number at each byte
    sizes = ends - begins
    return at_each[begins] & _FIRST[np.minimum(sizes, 8)], at_each[begins + 8] & _FIRST[np.clip(sizes - 8, 0, 8)]


class WordTable:
    """Word -> ids. Words of up to 16 bytes are their own keys, in an open-addressed table of
    arrays; longer ones are keys of a dictionary. Either way equal keys are equal words."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self._size(16)
        self.store, self.starts, self.sizes = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.long: dict[bytes, int] = {}
        self.n, self.used, self.short = 0, 0, 0

    def _size(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high, self.place = np.zeros(1 << bits, _U), np.zeros(1 << bits, _U), np.zeros(1 << bits, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        h = (h + high) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        return ((h * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def _put(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        slot = self._slots(low, high)
        while len(low):
            free = np.flatnonzero(self.low[slot] == 0)
            # Of several words for one free slot the first has it.
            free = free[np.unique(slot[free], return_index=True)[1]]
            into = slot[free]
            self.low[into], self.high[into], self.place[into] = low[free], high[free], place[free]
            left = np.ones(len(low), bool)
            left[free] = False
            low, high, place, slot = low[left], high[left], place[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each short word, or -1."""
        slot, out = self._slots(low, high), np.full(len(low), -1, np.int64)
        open_ = None  # all
        while len(slot):
            held = self.low[slot]
            hit = (held == (low if open_ is None else low[open_])) & (self.high[slot] == (high if open_ is None else high[open_]))
            on = np.flatnonzero(~hit & (held != 0))
            found = np.flatnonzero(hit)
            out[found if open_ is None else open_[found]] = self.place[slot[found]]
            open_ = on if open_ is None else open_[on]
            slot = (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Keep the ids of new entries; the first one's number."""
        total, first = len(ids), self.n
        while self.used + total > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        while self.n + len(counts) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.store[self.used : self.used + total] = ids
        self.starts[first : first + len(counts)] = self.used + np.cumsum(counts) - counts
        self.sizes[first : first + len(counts)] = counts
        self.n, self.used = self.n + len(counts), self.used + total
        return first

    def entries(self, blob: bytes, begins: np.ndarray, ends: np.ndarray, ids_of_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Entry of each word of a blob; new words are added."""
        out = np.empty(len(begins), np.int64)
        is_long = ends - begins > _KEY
        for i in np.flatnonzero(is_long).tolist():
            word = blob[begins[i] : ends[i]]
            if word not in self.long:
                self.long[word] = self._store(*ids_of_words([word.decode()]))
            out[i] = self.long[word]
        some = np.flatnonzero(~is_long)
        begins, ends = (begins, ends) if len(some) == len(begins) else (begins[some], ends[some])
        low, high = word_keys(blob, begins, ends)
        found = self.find(low, high)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            # One place of each new word: words are equal if both numbers are.
            order = missing[np.lexsort((high[missing], low[missing]))]
            head = np.ones(len(order), bool)
            head[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            first = order[head]
            made = self._store(*ids_of_words([blob[a:b].decode() for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]))
            self._add(low[first], high[first], np.arange(made, made + len(first), dtype=np.int32))
            found[order] = made + np.cumsum(head) - 1
        out[some] = found
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        self.short += len(low)
        if self.short > 1 << (self.bits - 1):
            held = np.flatnonzero(self.low)
            old = self.low[held], self.high[held], self.place[held]
            self._size(max(self.bits + 2, (2 * self.short - 1).bit_length()))
            self._put(*old)
        self._put(low, high, place)

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries in a row, how many each has)."""
        sizes, starts = self.sizes[entries], self.starts[entries]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.store[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes
