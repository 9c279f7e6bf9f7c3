"""Word-piece counts by a longest-match automaton, without making the pieces.

The vocabulary is a trie of byte strings. Where a walk down the trie can go no further, greedy longest match would take a
piece, or several, and go on with what is left of the bytes read; the trie node of that rest is the node's failure link, and
the number of pieces taken, precomputed, its pops (Song and others, 2021). So every byte is read once. Words of a batch
walk side by side in numpy, each distinct word once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import Codes, each_slice
from askwell.llm.tokens import byte_ranks, vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_WORDS = 250_000


@dataclass
class Automaton:
    """``child``: row of the transition table of each node (-1: a leaf); ``table``: rows of 256 next nodes (-1: none);
    ``fail``, ``pops``: failure link and pieces popped on the way; node 0 is the root."""

    child: np.ndarray
    table: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    @staticmethod
    def of(vocabulary) -> Automaton:
        """All 256 single bytes must be in the vocabulary, so that every byte string has pieces."""
        words = set(vocabulary)
        if not words >= {bytes([b]) for b in range(256)}:
            raise ValueError("a byte is not in the vocabulary")
        nexts, accept, strings = [{}], [False], [b""]
        for word in sorted(words):
            node = 0
            for byte in word:
                if byte not in nexts[node]:
                    nexts[node][byte] = len(nexts)
                    strings.append(strings[node] + bytes([byte]))
                    nexts.append({})
                    accept.append(False)
                node = nexts[node][byte]
            accept[node] = True
        fail, pops = np.zeros(len(nexts), dtype=np.int32), np.zeros(len(nexts), dtype=np.int32)
        queue = list(nexts[0].items())
        parents = {node: (0, byte) for byte, node in queue}
        order = [node for _, node in queue]
        for node in order:  # by depth
            for byte, child in nexts[node].items():
                parents[child] = (node, byte)
                order.append(child)
        for node in order:
            if accept[node]:
                pops[node] = 1  # the whole string is a piece, nothing is left
                continue
            parent, byte = parents[node]
            rest, taken = int(fail[parent]), int(pops[parent])
            while byte not in nexts[rest]:  # the root has every byte, so this ends
                taken, rest = taken + int(pops[rest]), int(fail[rest])
            fail[node], pops[node] = nexts[rest][byte], taken
        inner = [i for i, x in enumerate(nexts) if x]
        child = np.full(len(nexts), -1, dtype=np.int32)
        child[inner] = np.arange(len(inner))
        table = np.full((len(inner) + 1, 256), -1, dtype=np.int32)
        for row, node in enumerate(inner):
            table[row, list(nexts[node])] = list(nexts[node].values())
        return Automaton(child, table, fail, pops)  # the last row, reached by -1, has no way on

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; words go side by side, longest first, so those that ended fall off the end."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        node, taken = np.zeros(len(words), dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -at, side="left"))
            byte = data[starts[:live] + at]
            to = self.table[self.child[node[:live]], byte]
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                here = node[stuck]
                taken[stuck] += self.pops[here]
                node[stuck] = self.fail[here]
                to[stuck] = self.table[self.child[node[stuck]], byte[stuck]]
                stuck = stuck[to[stuck] < 0]
            node[:live] = to
        while (left := np.flatnonzero(node)).size:  # at the end of the word the rest is popped as well
            taken[left] += self.pops[node[left]]
            node[left] = self.fail[node[left]]
        out = np.empty(len(words), dtype=np.int64)
        out[order] = taken
        return out


KIND = pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64()), ("longest_word_tokens", pa.int64())])
SQL_KIND = "struct<n_words: bigint, n_tokens: bigint, longest_word_tokens: bigint>"


class Counter:
    """Counts of texts; a word is a run of what is no white space, read with a space before it."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.codes, self.known = automaton, Codes(), np.zeros(0, dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> pa.Array:
        if len(self.codes) > MOST_WORDS:
            self.codes, self.known = Codes(), np.zeros(0, dtype=np.int64)
        lookup = self.codes.__getitem__
        rows = [list(map(lookup, text.split())) if text else [] for text in texts]
        if fresh := self.codes.fresh():
            self.known = np.concatenate([self.known, self.automaton.counts([b" " + w.encode("utf-8", "surrogatepass") for w in fresh])])
        n = np.array([len(r) for r in rows], dtype=np.int64)
        pieces = self.known[np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))]
        doc = np.repeat(np.arange(len(rows)), n)
        total = np.bincount(doc, weights=pieces, minlength=len(rows)).astype(np.int64)
        longest = np.zeros(len(rows), dtype=np.int64)
        np.maximum.at(longest, doc, pieces)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total), pa.array(longest)], fields=list(KIND))


def token_counts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, longest_word_tokens`` of every document.

    Null and empty texts have no words. Repeated rows each get a row; an empty table gives none; other columns are not
    looked at. The automaton grows with the vocabulary only.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton.of(byte_ranks(vocabulary_path(VOCABULARY, folder))))

    @F.arrow_udf(SQL_KIND)
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each_slice(Counter(automaton.value), columns, KIND)

    return docs.select("doc_id", count.asNondeterministic()("text").alias("found")).select("doc_id", "found.*")
