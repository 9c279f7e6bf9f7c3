"""Token ids of texts by a public byte-pair vocabulary, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import base64
import importlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import tiktoken

from askwell.llm.common import Codes, ragged

#: Words kept by a worker before it starts anew.
MOST_WORDS = 250_000
#: White space beside a space.
BESIDE = re.compile(r" \s|\s ")


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies: in ``folder``, or where the installed package says."""
    return f"{folder.rstrip('/')}/{name}" if folder else importlib.import_module("public_tokenizers").path(name)


def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def units(text: str) -> list[str]:
    """The text cut before each single space between two characters that are no white space. The vocabulary's pattern
    has no match across such a place, so pieces can be encoded one by one. Other white space stays inside a piece."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        last = out[-1]
        if part and last and not part[0].isspace() and not last[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] = last + " " + part
    return out


class Encoder:
    """Ids of texts, equal to those of the byte-level tokenizer of the same vocabulary without special tokens."""

    def __init__(self, path: str):
        ranks = byte_ranks(path)
        pattern = importlib.import_module("public_tokenizers").PATTERN
        self.bpe = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(len(ranks) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.forget()

    def forget(self) -> None:
        """A word stands for itself after a space; a piece that is encoded as it is stands in a tuple."""
        self.codes = Codes()
        self.ids = np.zeros(0, dtype=np.uint16)
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)
        self.odd = np.zeros(0, dtype=bool)

    def learn(self) -> None:
        """Encodes new words as one text: each begins with the only space in it, so the cuts between them hold."""
        fresh = self.codes.fresh()
        alone = {i: self.bpe.encode_ordinary(x[0]) for i, x in enumerate(fresh) if type(x) is tuple}
        words = [x for x in fresh if type(x) is str]
        where = np.delete(np.arange(len(fresh)), list(alone)) if alone else np.arange(len(fresh))
        odd = np.zeros(len(fresh), dtype=bool)
        text = " ".join(["", *words])
        if BESIDE.search(text + " "):
            odd[where] = [not x or x[0].isspace() or x[-1].isspace() for x in words]
            words = [x for x in words if not (not x or x[0].isspace() or x[-1].isspace())]
            where = where[~odd[where]]
            text = " ".join(["", *words])
        ids = np.array(self.bpe.encode_ordinary(text), dtype=np.uint16)
        begins = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) == 32)
        cuts = np.r_[np.searchsorted(np.cumsum(self.sizes[ids]) - self.sizes[ids], begins), len(ids)]
        starts, lengths = np.zeros((2, len(fresh)), dtype=np.int64)
        starts[where], lengths[where] = len(self.ids) + cuts[:-1], np.diff(cuts)
        at, sizes = list(alone), np.array([len(x) for x in alone.values()], dtype=np.int64)
        lengths[at], starts[at] = sizes, len(self.ids) + len(ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, ids, np.array([x for v in alone.values() for x in v], dtype=np.uint16)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.odd = np.concatenate([self.odd, odd])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's ids. Null is empty."""
        if len(self.codes) > MOST_WORDS:
            self.forget()
        lookup, codes = self.codes.__getitem__, []
        for text in texts:
            if text:
                words = text.split(" ")
                words[0] = (words[0],)
                codes.append(list(map(lookup, words)))
            else:
                codes.append([])
        if self.codes.new:
            self.learn()
        counts = np.array([len(x) for x in codes], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(codes), np.int64, int(counts.sum()))
        spaced = self.odd[flat]
        if spaced.any():  # white space beside a space: such texts are cut with more care
            for i in np.unique(np.repeat(np.arange(len(texts)), counts)[spaced]).tolist():
                codes[i] = [lookup((piece,)) for piece in units(texts[i])]
            if self.codes.new:
                self.learn()
            counts = np.array([len(x) for x in codes], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(codes), np.int64, int(counts.sum()))
        lengths = self.lengths[flat]
        ids = self.ids[ragged(self.starts[flat], lengths)]
        return ids, np.diff(np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
