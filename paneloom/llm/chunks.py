"""Token ids of whole texts from cached ids of their words.

A tokenizer that splits a text before it merges gives a word the same ids wherever the word stands,
so a text's ids are its words' ids end to end. Each word goes through the tokenizer once and stays
in a bounded cache; texts whose white space or punctuation makes word borders uncertain go through
the tokenizer whole. The ids are the tokenizer's in either case.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from itertools import filterfalse
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in each of two generations; a word takes about 200 bytes.
CACHED_WORDS = 400_000
TEXTS_AT_ONCE = 500


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What ``make`` builds, kept in this Python worker until another key is asked for.

    A worker outlives its task, so the tables of one operator go before those of the next are built.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()  # caches and their encoder name each other, so they don't go by themselves
        _HELD[key] = make()
    return _HELD[key]


class WordCache:
    """Results by word, two generations of bounded size; ``make`` gives those of new words."""

    def __init__(self, make: Callable[[list[str]], list], size: int = CACHED_WORDS):
        self.make, self.size = make, size
        self.now: dict = {}
        self.before: dict = {}

    def values(self, words: list[str]) -> list:
        """The result of each of ``words``."""
        if len(self.now) > self.size:
            self.before, self.now = self.now, {}
        new = list(dict.fromkeys(filterfalse(self.now.__contains__, words)))
        if new:
            unseen = list(filterfalse(self.before.__contains__, new))
            if len(unseen) < len(new):
                self.now.update((w, self.before[w]) for w in new if w in self.before)
            if unseen:
                self.now.update(zip(unseen, self.make(unseen), strict=True))
        return list(map(self.now.__getitem__, words))


#: A full stop or comma that is split off right after another one, with which it forms one unit.
MARK_PAIRS = (" . . ", " . , ", " , . ", " , , ")


def part_marks(text: str) -> str | None:
    """The text with a space before each full stop or comma that a space or line end follows.

    None where two of them are side by side.
    """
    parted = f" {text} ".replace(". ", " . ").replace(", ", " , ")
    return None if any(pair in parted for pair in MARK_PAIRS) else parted[1:-1]


def concatenated(values: list[bytes | None], at: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each text the values of its words end to end; ``at`` has a word's place in ``values``."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(at))
    where = np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1]
    data = memoryview(taken.buffers()[2] or b"")
    borders = where[np.concatenate([[0], ends])].tolist()
    return [bytes(data[x:y]) for x, y in zip(borders, borders[1:], strict=False)]


def summed(values: list[int | None], at: np.ndarray, ends: np.ndarray) -> list[int]:
    """For each text the sum of its words' values."""
    upto = np.concatenate([[0], np.cumsum(np.array([v or 0 for v in values], np.int64)[at])])
    return np.diff(upto[np.concatenate([[0], ends])]).tolist()


#: What a byte-level vocabulary writes for each byte.
SHOWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
BYTE_SYMBOLS = {b: chr(b) for b in SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SHOWN)}
#: Letters below this one are looked at when plain words are told from others.
LETTERS_END = 0x250


def plain_words(tokenizer, specials: tuple[str, ...]) -> re.Pattern | None:
    """Pattern of the words that the tokenizer neither normalises nor splits, so that its model alone decides.

    They consist of Latin letters, after a space if the tokenizer keeps that as a part of the word.
    None if it splits a run of all these letters, or writes bytes in another way.
    """
    changed = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    letters = "".join(c for c in map(chr, range(LETTERS_END)) if c.isalpha() and changed(c) == c)

    def whole(text: str) -> bool:
        pieces = [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else []
        return changed(text) == text and pieces == ["".join(map(BYTE_SYMBOLS.get, text.encode()))]

    if not letters or any(s.strip().isalpha() for s in specials) or not whole(letters + letters[::-1]):
        return None
    return re.compile(f"{' ?' if whole(' ' + letters + letters[::-1]) else ''}[{letters}]+")


def library(path: str) -> tuple[Callable, tuple[str, ...]]:
    """Call of the tokenizers library that gives each text's ids as little-endian 32-bit integers; its special strings.

    Plain words go to the library's model at once. Many other texts go in one call with a special
    string between them, which the library splits off before all else; its id then parts the ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    specials = special_strings(path)
    plain, model = plain_words(tokenizer, specials), tokenizer.model
    written = {b: c for b, c in BYTE_SYMBOLS.items() if b != ord("\n")}

    def encode(texts: list[str]) -> list[bytes]:
        found = list(map(plain.fullmatch, texts)) if plain else [None] * len(texts)
        words = encode_words([t for t, hit in zip(texts, found, strict=True) if hit])
        if len(words) == len(texts):
            return words
        words, others = iter(words), iter(encode_others([t for t, hit in zip(texts, found, strict=True) if not hit]))
        return [next(words) if hit else next(others) for hit in found]

    def encode_words(words: list[str]) -> list[bytes]:
        ids, ends = [], [0]
        for symbols in "\n".join(words).encode().decode("latin-1").translate(written).split("\n") if words else ():
            ids += [token.id for token in model.tokenize(symbols)]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)]

    def encode_others(texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        whole = "\n".join(texts)
        if not specials or any(s in whole for s in specials):
            return [np.array(e.ids, "<u4").tobytes() for e in batch(texts, add_special_tokens=False)]
        border, out = tokenizer.token_to_id(specials[0]), []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            joined = specials[0].join(texts[at : at + TEXTS_AT_ONCE])
            ids = np.array(batch([joined], add_special_tokens=False)[0].ids, "<u4")
            cut, raw = np.flatnonzero(ids == border) * 4, ids.tobytes()
            out += [raw[x:y] for x, y in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True)]
        return out

    return encode, specials


def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file)["added_tokens"])


class Encoder:
    """Results for whole texts, joined from those of their words.

    ``encode`` gives the result of each text in a list; ``join`` those of texts from their words',
    :func:`concatenated` or :func:`summed`. Texts are split and words are numbered by Arrow, so
    Python sees each word of a batch once.
    ``lowered`` says that the tokenizer lowers case and drops white space; else it must keep the
    space before a word, and a line end stays at the front of its word.
    """

    def __init__(self, encode: Callable, specials: tuple[str, ...], join: Callable, lowered: bool = False):
        self.encode, self.specials, self.join, self.lowered = encode, specials, join, lowered
        self.parted = WordCache(lambda words: self._make(words, True), CACHED_WORDS)
        self.joined = WordCache(lambda words: self._make(words, False), CACHED_WORDS // 4)

    def _make(self, words: list[str], parted: bool) -> list:
        good = [i for i, w in enumerate(words) if self._certain(w, parted)]
        out: list = [None] * len(words)
        for i, value in zip(good, self.encode([self._text(words[i], parted) for i in good]) if good else (), strict=True):
            out[i] = value
        return out

    def _text(self, word: str, parted: bool) -> str:
        """Words start with their white space; a first word is marked by a NUL instead."""
        if word[:1] == "\0":
            return word[1:]
        return word if self.lowered or word[:1] == "\n" or parted and word in (".", ",") else " " + word

    def _certain(self, word: str, parted: bool) -> bool:
        """None is cached for other words, with white space of their own beside a border: their texts are
        split in a plainer way or not at all."""
        if word in (".", ",") if parted else self.lowered:
            return True
        bare = word[1:] if word[:1] in ("\n", "\0") else word
        return bool(bare) and bare.isprintable()

    def _prepared(self, text: str) -> str | None:
        """The text with spaces as its only borders, or None if it must be encoded whole."""
        if not text or "\0" in text:
            return None
        if self.lowered:
            low = text.replace("\n", " ").lower()
            plain = text.isascii() or "Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)
            return low if plain and not any(s in low for s in self.specials) else None
        return None if any(s in text for s in self.specials) else "\0" + text.replace("\n", " \n")

    def _from_words(self, texts: list[str], cache: WordCache) -> list:
        """The results of texts whose words are all certain, None for the others."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        numbered = split.values.dictionary_encode()
        # the words as one text and back: quicker than one by one
        words = " ".join(pc.binary_join(pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary), " ").to_pylist()).split(" ")
        values = cache.values(words)
        at, ends = numbered.indices.to_numpy(), split.offsets.to_numpy()[1:].astype(np.int64)
        unsure = np.array([v is None for v in values], bool)[at]
        if cache is self.parted:  # a mark right before a split-off full stop or comma would have formed one unit with it
            stops = np.array([w in (".", ",") for w in words], bool)[at]
            before = np.flatnonzero(stops[1:])
            alone = np.ones(len(words), bool)
            used = np.unique(at[before])
            alone[used] = [words[i][-1:].isalnum() for i in used.tolist()]
            unsure[before] |= ~alone[at[before]]
        upto = np.concatenate([[0], np.cumsum(unsure)])[np.concatenate([[0], ends])]
        return [r if sure else None for r, sure in zip(self.join(values, at, ends), np.diff(upto) == 0, strict=True)]

    def batch(self, texts: list[str]) -> list:
        out: list = [None] * len(texts)
        prepared = [self._prepared(t) for t in texts]
        for split, cache in ((part_marks, self.parted), (lambda text: text, self.joined)):
            some = {i: split(t) for i, t in enumerate(prepared) if t is not None and out[i] is None}
            some = {i: t for i, t in some.items() if t is not None}
            if some:
                for i, result in zip(some, self._from_words(list(some.values()), cache), strict=True):
                    out[i] = result
        rest = [i for i, value in enumerate(out) if value is None]
        for i, value in zip(rest, self.encode([texts[i] for i in rest]) if rest else (), strict=True):
            out[i] = value
        return out
