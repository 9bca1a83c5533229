"""Texts as units that tokenizers treat alike wherever they stand, so that each distinct one is encoded once.

A single space between two characters other than white space starts a new token in a byte-level BPE whose
pattern joins white space to what follows as one leading space, and in a piece model none of whose pieces
holds a space after another character. Texts are cut before such spaces, and nowhere else.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import suppress
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Units and their ids that a worker remembers from chunk to chunk.
REMEMBERED, IDS = 600_000, 8_000_000
#: Units given to a tokenizer at once, and in one text.
AT_ONCE, TOGETHER = 5_000, 500
#: Texts put together at once.
TEXTS = 256


def parts(text: str) -> list[str]:
    """The text cut at its single spaces between other characters, which are left out."""
    alone = " ".join(text.split()) == text.replace("\n", " ") and text  # no white space stands next to other
    return text.split(" ") if alone else _BETWEEN.split(text)


def numbered(words: list[str], known: dict[str, int]) -> np.ndarray:
    """The number of each word in known, to which new ones are added."""
    codes = list(map(known.get, words))
    at = 0
    with suppress(ValueError):  # when no more is new
        while True:
            at = codes.index(None, at)
            codes[at] = known.setdefault(words[at], len(known))
    return np.fromiter(codes, np.int64, len(codes))


def text_chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Keys (first column) and texts (second; null is empty), so many code points at once and a text more."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


@cache
def byte_bpe(path: str, special_as_text: bool = False):
    """A tokenizer of the tokenizers library that stays within its task's core; a worker reads it once for all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = special_as_text
    return out


def gathered(first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the elements of the runs codes, one run after the other."""
    n = size[codes]
    return np.arange(int(n.sum())) + np.repeat(first[codes] - (np.cumsum(n) - n), n)


class Spaced:
    """A byte-level BPE over many units at once: units that hold no white space and are led by a space are encoded as one text, and told apart by their first tokens."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        space = tokenizer.encode(" a").tokens[0][0]  # how the vocabulary writes a space
        self.spaced = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.spaced[[i for t, i in tokenizer.get_vocab().items() if t[0] == space]] = True

    def encode(self, words: list[str], lead: str = " ") -> tuple[np.ndarray, np.ndarray]:
        """The ids of lead+word for all words, one after the other, and how many each has."""
        encode = partial(self.tokenizer.encode_batch_fast, add_special_tokens=False)
        if lead == " " and " " not in "".join(words):
            texts = [" " + " ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in encode(texts)), np.uint32)
            return ids, np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids))
        ids = [e.ids for e in encode([lead + w for w in words])]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64)


class Remembered:
    """Distinct units by number, of which the most used stay when there are too many."""

    def __init__(self, most: int):
        self.most, self.known = most, {}
        self.used = np.empty(0, np.int64)

    def kept(self) -> np.ndarray:
        """The numbers that stay, in order; half as many as are remembered at most."""
        words, keep = list(self.known), np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        keep = keep[self.used[keep] > 1]
        self.known = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.used = self.used[keep] // 2
        return keep

    def number(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[str]]:
        """The numbers of each text's units, and the units that are new."""
        had = len(self.known)
        codes = [numbered(t, self.known) for t in texts]
        self.used = np.append(self.used, np.zeros(len(self.known) - had, np.int64))
        if codes:
            self.used += np.bincount(np.concatenate(codes), minlength=len(self.used))
        return codes, list(self.known)[had:]


class Ids(Remembered):
    """Ids of units by one byte-level BPE, each after a given lead."""

    def __init__(self, spaced: Spaced, lead: str):
        super().__init__(REMEMBERED)
        self.spaced, self.lead = spaced, lead
        self.flat, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The units of each text by number."""
        if len(self.known) > self.most or len(self.flat) > IDS:
            keep = self.kept()
            self.flat, self.size = self.flat[gathered(np.cumsum(self.size) - self.size, self.size, keep)], self.size[keep]
        out, new = self.number(texts)
        done = [self.spaced.encode(new[start : start + AT_ONCE], self.lead) for start in range(0, len(new), AT_ONCE)]
        self.flat, self.size = np.concatenate([self.flat, *[d[0] for d in done]]), np.concatenate([self.size, *[d[1] for d in done]])
        return out


class Encoder:
    """Ids of whole texts: of their first units, which no space leads, and of the others."""

    def __init__(self, tokenizer):
        spaced = Spaced(tokenizer)
        self.heads, self.rests = Ids(spaced, ""), Ids(spaced, " ")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [parts(t) for t in texts]
        heads, rests = self.heads.codes([p[:1] for p in cut]), self.rests.codes([p[1:] for p in cut])
        del cut
        flat, size = np.concatenate([self.heads.flat, self.rests.flat]), np.concatenate([self.heads.size, self.rests.size])
        first, shift = np.cumsum(size) - size, len(self.heads.size)
        for start in range(0, len(texts), TEXTS):
            codes = [c for h, r in zip(heads[start : start + TEXTS], rests[start : start + TEXTS], strict=True) for c in (h, r + shift)]
            stops = np.cumsum([len(c) for c in codes])[1::2]
            runs = np.concatenate(codes)
            ids, ends = flat[gathered(first, size, runs)], np.cumsum(size[runs])[stops - 1]
            yield from np.split(ids, ends[:-1])


@cache
def encoder(path: str) -> Encoder:
    """What a worker remembers for all its tasks."""
    return Encoder(byte_bpe(path))
