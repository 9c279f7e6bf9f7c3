"""Tokens of one text under two tokenizers, aligned by their bytes, and how often ids of both are linked corpus-wide.

Tokenizer A reads a space and the text, tokenizer B adds that space itself, so both token rows cover the same bytes. Per batch of
documents, ``pandas.merge_asof`` keyed by document finds for each token start the other side's token that covers it; the
union of both directions is the set of overlaps. Overlapping tokens with equal ends close a group; all A tokens of a group
are linked with all its B tokens.

Ids come from stretches of text: a stretch ends before a space between two characters that are no white space, where neither
tokenizer has a token that goes on. Each distinct stretch is encoded once per worker; a long document is aligned in parts
that end with a stretch, so memory is bounded by the part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwell.llm.common import Codes, cut, ragged, written
from askwell.llm.tokens import BESIDE, byte_ranks, units, vocabulary_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A worker forgets its stretches beyond so many, or so many characters.
MOST_STRETCHES, MOST_CHARACTERS = 200_000, 16_000_000
#: Characters of one part of a document, about; links made at a time.
PART, LINKS = 1 << 20, 4_000_000
#: Pairs of ids that are broadcast, at most: the most frequent ones. The others are shuffled.
HEAD = 200_000


class Pair:
    """Both tokenizers, with the byte length of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from public_tokenizers import PATTERN

        ranks = byte_ranks(a_path)
        self.a = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = len(ranks) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        a, b = ([str(i) for i in range(n)] for n in (self.n_a, self.n_b))
        #: What a token adds to the text of the groups, by side and by what comes after it.
        self.shown = pa.array([x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b], pa.large_string())
        self.forget()

    def forget(self) -> None:
        self.codes = Codes()
        self.characters = 0
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.starts, self.lengths = np.zeros((2, 2, 0), dtype=np.int64)
        self.exact = np.zeros(0, dtype=bool)

    def learn(self) -> None:
        """Encodes new stretches, given without their first space. A's side goes through as one text where the ends of the
        stretches are cuts; B's bytes are compared with the stretches, as only B may change bytes."""
        fresh = self.codes.fresh()
        self.characters += sum(map(len, fresh))
        alone = [i for i, x in enumerate(fresh) if not x or x[0].isspace() or x[-1].isspace()]
        where = np.delete(np.arange(len(fresh)), alone)
        text = "".join([" " + fresh[i] for i in where])
        ids = np.array(self.a.encode_ordinary(text), dtype=np.int32)
        raw = [(" " + x).encode() for x in fresh]
        bytes_of = np.array([len(x) for x in raw], dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(self.a_sizes[ids]), np.r_[0, np.cumsum(bytes_of[where])], side="right")
        cuts[0] = 0
        apart = [self.a.encode_ordinary(" " + fresh[i]) for i in alone]
        a_lengths, a_starts = np.zeros((2, len(fresh)), dtype=np.int64)
        a_lengths[where], a_starts[where] = np.diff(cuts), cuts[:-1]
        a_lengths[alone] = [len(x) for x in apart]
        a_starts[alone] = len(ids) + np.cumsum(a_lengths[alone]) - a_lengths[alone]
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(apart), np.int32)])
        pieces = self.b.encode(fresh)
        b_lengths = np.array([len(x) for x in pieces], dtype=np.int64)
        table = self.b_bytes
        exact = [b"".join([table[i] for i in row]) == x for row, x in zip(pieces, raw)]
        b_starts = np.cumsum(b_lengths) - b_lengths
        self.starts = np.concatenate([self.starts, [a_starts + len(self.ids[0]), b_starts + len(self.ids[1])]], axis=1)
        self.lengths = np.concatenate([self.lengths, [a_lengths, b_lengths]], axis=1)
        self.ids = [np.concatenate([self.ids[0], ids]), np.concatenate([self.ids[1], np.fromiter(chain.from_iterable(pieces), np.int32, int(b_lengths.sum()))])]
        self.exact = np.concatenate([self.exact, exact])

    def stretches(self, text: str) -> list[int]:
        """Codes of the stretches of a space and the text, which each begin with a space."""
        if BESIDE.search(text) or text[0].isspace() or text[-1].isspace():
            return [self.codes[x[1:]] for x in units(" " + text)]
        return list(map(self.codes.__getitem__, text.split(" ")))

    def parts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Parts of bounded size: which texts are in it, and for both sides the ids of their tokens and, for each, its text.
        Texts of which a stretch is not exact have no tokens."""
        if len(self.codes) > MOST_STRETCHES or self.characters > MOST_CHARACTERS:
            self.forget()
        codes = [self.stretches(text) if text else [] for text in texts]
        if self.codes.new:
            self.learn()
        waiting: list[tuple[int, list[int]]] = []
        size = 0
        for i, row in enumerate(codes):
            if not row or not self.exact[row].all():
                continue
            each = max(1, len(row) * PART // len(texts[i]))
            for at in range(0, len(row), each):
                waiting.append((i, row[at : at + each]))
                size += min(len(texts[i]), PART)
                if size >= PART:
                    yield self.part(waiting)
                    waiting, size = [], 0
        if waiting:
            yield self.part(waiting)

    def part(self, waiting: list[tuple[int, list[int]]]):
        counts = np.array([len(x) for _, x in waiting])
        codes = np.fromiter(chain.from_iterable(x for _, x in waiting), np.int64, int(counts.sum()))
        texts = np.repeat(np.array([i for i, _ in waiting]), counts)
        lengths = self.lengths[:, codes]
        ids = [self.ids[side][ragged(self.starts[side][codes], lengths[side])] for side in (0, 1)]
        return np.unique(texts), ids, [np.repeat(texts, lengths[side]) for side in (0, 1)]


@lru_cache(maxsize=1)
def pair(a_path: str, b_path: str) -> Pair:
    """One per worker process."""
    return Pair(a_path, b_path)


def covering(starts: np.ndarray, docs: np.ndarray, other_starts: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """For each token start, the other side's token that covers it."""
    left = pd.DataFrame({"start": starts, "doc": docs})
    right = pd.DataFrame({"start": other_starts, "doc": other_docs, "token": np.arange(len(other_starts))})
    return pd.merge_asof(left, right, on="start", by="doc")["token"].to_numpy(dtype=np.int64)


def aligned(sizes: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Overlaps (rows: A token, B token; each once) and for both sides the number of each token's group. ``sizes``: bytes of
    the tokens; ``docs``: their documents. Both sides of a document have the same bytes in all."""
    ends = [np.cumsum(x) for x in sizes]
    starts = [e - x for e, x in zip(ends, sizes)]
    b_of_a, a_of_b = covering(starts[0], docs[0], starts[1], docs[1]), covering(starts[1], docs[1], starts[0], docs[0])
    later = np.flatnonzero(starts[0][a_of_b] != starts[1])  # tokens that start together are found from both sides
    overlaps = np.stack([np.r_[np.arange(len(b_of_a)), a_of_b[later]], np.r_[b_of_a, later]], axis=1)
    closing = overlaps[ends[0][overlaps[:, 0]] == ends[1][overlaps[:, 1]]]
    groups = []
    for side in (0, 1):
        closes = np.zeros(len(ends[side]), dtype=np.int64)
        closes[closing[:, side]] = 1
        groups.append(np.cumsum(closes) - closes)
    return overlaps, groups


def linked(ids: list[np.ndarray], docs: np.ndarray, groups: list[np.ndarray], n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of linked ids of each document as one number (document, A id * ``n_b`` + B id), and how many
    links each has. Equal ids of a group are taken together first, so a long group costs its distinct ids."""
    count = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    sizes = [np.bincount(g, minlength=count) for g in groups]
    large = sizes[0] * sizes[1] > 256
    entries = []
    for side in (0, 1):
        wide = large[groups[side]]
        group, token = groups[side][~wide], ids[side][~wide].astype(np.int64)
        weight = np.ones(len(group), dtype=np.int64)
        if wide.any():
            key, n = np.unique((groups[side][wide] << 20) | ids[side][wide], return_counts=True)
            group, token, weight = np.r_[group, key >> 20], np.r_[token, key & 0xFFFFF], np.r_[weight, n]
            order = np.argsort(group, kind="stable")
            group, token, weight = group[order], token[order], weight[order]
        entries.append((group, token, weight))
    (ga, ta, wa), (gb, tb, wb) = entries
    per_group = np.bincount(gb, minlength=count)
    first = np.cumsum(per_group) - per_group
    doc_of = np.zeros(count, dtype=np.int64)
    doc_of[groups[0]] = docs
    each = per_group[ga]
    total = np.cumsum(each)
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(ga):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, side="right")))
        n = each[at:stop]
        right = ragged(first[ga[at:stop]], n)
        key = np.repeat((doc_of[ga[at:stop]] << 31) | (ta[at:stop] * n_b), n) + tb[right]
        keys, times = summed(np.r_[keys, key], np.r_[times, np.repeat(wa[at:stop], n) * wb[right]])
        at = stop
    return keys, times


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    if not len(keys):
        return keys, times
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(times, new)


def shown(pair: Pair, ids: list[np.ndarray], groups: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of the groups of all documents, one after the other, as bytes: ``a,a|b;a|b,b;``; and for each of ``docs`` there
    are, in order, where its text begins and ends."""
    count = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    sizes = [np.bincount(g, minlength=count) for g in groups]
    last = [np.cumsum(n) - 1 for n in sizes]
    n = len(ids[0]) + len(ids[1])
    what = np.zeros(n, dtype=np.int64)
    ends = [np.zeros(len(x), dtype=np.int64) for x in ids]
    for side in (0, 1):
        ends[side][last[side]] = 1
    what[np.arange(len(ids[0])) + (np.cumsum(sizes[1]) - sizes[1])[groups[0]]] = ids[0] + ends[0] * pair.n_a
    what[np.arange(len(ids[1])) + np.cumsum(sizes[0])[groups[1]]] = 2 * pair.n_a + ids[1] + ends[1] * pair.n_b
    text = pair.shown.take(pa.array(what))
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[: n + 1]
    per_doc = [np.flatnonzero(np.r_[True, np.diff(d) != 0, True]) if len(d) else np.zeros(1, np.int64) for d in docs]
    tokens = per_doc[0] + per_doc[1]
    return np.frombuffer(text.buffers()[2], dtype=np.uint8), offsets[tokens[:-1]], offsets[tokens[1:]]


LINKED = pa.list_(pa.struct([("pair", pa.int32()), ("times", pa.int64())]))
COLUMNS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:int,times:bigint>>"


def documents_linked(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """For each row of ``docs`` its tokens, groups, links and pairs of linked ids. A pair is A id * (number of B ids) + B id."""
    files = vocabulary_path(A_VOCABULARY, folder), vocabulary_path(B_VOCABULARY, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = pair(*files), TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for column in cut(batch.column("text")):
                yield link_batch(both, batch.column("doc_id").slice(done, len(column)), column.to_pylist(), row)
                done, row = done + len(column), row + len(column)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


def link_batch(both: Pair, doc_ids: pa.Array, texts: list[str | None], row: int) -> pa.RecordBatch:
    n = len(texts)
    counts = np.zeros((4, n), dtype=np.int64)
    hashes = [None] * n
    found = []
    for present, ids, docs in both.parts(texts):
        _, groups = aligned([both.a_sizes[ids[0]], both.b_sizes[ids[1]]], docs)
        doc_of = np.zeros(int(groups[0][-1]) + 1, dtype=np.int64)
        doc_of[groups[0]] = docs[0]
        links = np.bincount(groups[0]) * np.bincount(groups[1])
        for to, where, what in ((0, docs[0], 1), (1, docs[1], 1), (2, doc_of, 1), (3, doc_of, links)):
            np.add.at(counts[to], where, what)
        text, starts, ends = shown(both, ids, groups, docs)
        for i, s, e in zip(present.tolist(), starts.tolist(), ends.tolist()):
            if hashes[i] is None:
                hashes[i] = hashlib.sha256(text[s : e - 1])
            else:  # a further part of a long text
                hashes[i].update(b";")
                hashes[i].update(text[s : e - 1])
        found.append(linked(ids, docs[0], groups, both.n_b))
        if sum(len(k) for k, _ in found) > 4 * LINKS:
            found = [summed(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found]))]
    keys, times = summed(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])) if found else (np.zeros(0, np.int64),) * 2
    offsets = np.searchsorted(keys, np.arange(n + 1) << 31)
    struct = pa.StructArray.from_arrays([pa.array(keys & 0x7FFFFFFF, pa.int32()), pa.array(times, pa.int64())], fields=list(LINKED.value_type))
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(row, row + n)), doc_ids, *(pa.array(c) for c in counts),
        pa.array(["" if h is None else h.hexdigest() for h in hashes]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
    ], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def token_groups(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of ``docs`` the alignment itself: token ids of both sides, each token's group, and overlapping tokens by their
    places. Null and empty texts, and such as one side does not keep byte for byte, have empty arrays."""
    files = vocabulary_path(A_VOCABULARY, folder), vocabulary_path(B_VOCABULARY, folder)
    names = ["a_ids", "b_ids", "a_groups", "b_groups", "a_overlaps", "b_overlaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*files)
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                out, groups_done, tokens_done = {k: [] for k in names}, 0, np.zeros(2, dtype=np.int64)
                for _, ids, of in both.parts([text]):
                    overlaps, groups = aligned([both.a_sizes[ids[0]], both.b_sizes[ids[1]]], of)
                    overlaps = overlaps[np.lexsort((overlaps[:, 1], overlaps[:, 0]))]
                    for side, x in enumerate("ab"):
                        out[f"{x}_ids"].append(ids[side])
                        out[f"{x}_groups"].append(groups[side] + groups_done)
                        out[f"{x}_overlaps"].append(overlaps[:, side] + tokens_done[side])
                    groups_done += int(groups[0][-1]) + 1
                    tokens_done += [len(x) for x in ids]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64())} | {
                    k: pa.array([np.concatenate(v) if v else []], pa.list_(pa.int32())) for k, v in out.items()})

    kind = "doc_id bigint, " + ", ".join(f"{k} array<int>" for k in names)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """In how many documents each pair of ids is linked (``held``), and whether that is the most of its A id. An A id
    has at most ``n_b`` pairs."""
    held = rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held"))
    most = F.max("held").over(Window.partitionBy(F.floor(F.col("pair") / n_b)))
    return written(held.withColumn("best", F.col("held") == most), "pair-counts")


def cross_tokenizer(docs: DataFrame, folder: str | None = None, head: int = HEAD) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of each row of ``docs``.

    Null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros, and an empty string. Rows that
    repeat or have no id are documents like others, and count as such. Other columns are not read.

    Counts come back to the documents in two ways at any size: those of the most frequent pairs, at most ``head`` of them, are
    broadcast, so that a pair that all documents hold is never one task's; rarer pairs are shuffled.
    """
    n_b = pair(vocabulary_path(A_VOCABULARY, folder), vocabulary_path(B_VOCABULARY, folder)).n_b
    rows = written(documents_linked(docs, folder), "linked")
    counts = pair_counts(rows, n_b)
    by_size = counts.groupBy(F.floor(F.log2("held")).alias("size")).count().orderBy(F.desc("size")).collect()  # 64 rows at most
    total, least = 0, 1 << 62
    for size, n in by_size:
        if (total := total + n) > head:
            break
        least = 1 << size
    frequent = F.broadcast(counts.filter(F.col("held") >= least))
    links = rows.select("row", F.inline("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum")]
    found = links.join(frequent, "pair").groupBy("row").agg(*sums)
    if total > head:
        rare = links.join(frequent.select("pair"), "pair", "left_anti").join(counts.filter(F.col("held") < least), "pair")
        found = found.unionByName(rare.groupBy("row").agg(*sums))
        found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("links").join(found, "row", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
