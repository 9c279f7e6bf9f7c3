"""Quality classifier on supervised subword embeddings.

A document is the mean of the vectors of its words, word pairs and character n-grams, hashed into ``2 ** BITS`` rows; a softmax over
two classes reads it. Vectors and output weights are learned together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. Since the mean is linear, a row's vector times the output weights is one number, and
a document is scored by the mean of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import Codes, cut, each_slice, held_out, mix, ragged

BITS, DIMS = 16, 12
SHORTEST, LONGEST = 2, 4
MOST_WORDS = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)
MASK = np.uint64((1 << BITS) - 1)


def word_features(words: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of each word one after the other, and their number: the word itself (by its hash) first, then its
    character n-grams with ``<`` and ``>`` at its ends."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], dtype=np.int64) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - (np.cumsum(lengths) - lengths)[word]
    counts = {n: np.maximum(lengths - n + 1, 0) for n in range(SHORTEST, LONGEST + 1)}
    sizes = 1 + sum(counts.values())
    begin = np.cumsum(sizes) - sizes
    rows = np.empty(int(sizes.sum()), dtype=np.int32)
    rows[begin] = hashes & MASK
    begin = begin + 1
    with np.errstate(over="ignore"):
        for n, count in counts.items():
            inside = np.flatnonzero(place + n <= lengths[word])
            folded = points[inside] + np.uint64(n)
            for j in range(1, n):
                folded = folded * STEP + points[inside + j]
            rows[(begin[word] + place)[inside]] = mix(folded) & MASK
            begin = begin + count
    return rows, sizes


class Features:
    """Features of texts; a word's are worked out once per worker."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.codes, self.rows = Codes(), np.zeros(0, dtype=np.int32)
        self.starts = self.sizes = np.zeros(0, dtype=np.int64)
        self.hashes = np.zeros(0, dtype=np.uint64)

    def codes_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word codes of all texts, and the number of each text's words."""
        if len(self.codes) > MOST_WORDS:
            self.forget()
        lookup = self.codes.__getitem__
        rows = [list(map(lookup, text.replace("\n", " \n ").split(" "))) if text else [] for text in texts]
        if self.codes.new:
            words = self.codes.fresh()
            hashes = mix(np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64))
            new_rows, sizes = word_features(words, hashes)
            self.starts = np.concatenate([self.starts, len(self.rows) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.rows = np.concatenate([self.rows, new_rows])
            self.hashes = np.concatenate([self.hashes, hashes])
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts

    def pairs(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of neighbouring words, and the documents they are in."""
        inside = doc[1:] == doc[:-1]
        with np.errstate(over="ignore"):
            hashed = mix(self.hashes[codes[:-1][inside]] * STEP + self.hashes[codes[1:][inside]])
        return (hashed & MASK).astype(np.int64), doc[1:][inside]

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature rows of one text, and how often each is in it."""
        codes, counts = self.codes_of([text])
        pair_rows, _ = self.pairs(codes, np.zeros(len(codes), dtype=np.int64))
        own = self.rows[ragged(self.starts[codes], self.sizes[codes])] if len(codes) else np.zeros(0, dtype=np.int64)
        return np.unique(np.concatenate([own, pair_rows]).astype(np.int32), return_counts=True)


class Scorer:
    """The trained model as one number for each feature row, and one for all texts."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias

    def scores(self, features: Features, texts: list[str | None]) -> np.ndarray:
        codes, counts = features.codes_of(texts)
        doc = np.repeat(np.arange(len(texts)), counts)
        # of each distinct word in this slice: the sum over its features
        distinct, place = np.unique(codes, return_inverse=True)
        sizes = features.sizes[distinct]
        of_word = np.add.reduceat(self.logits[features.rows[ragged(features.starts[distinct], sizes)]], np.cumsum(sizes) - sizes) if len(distinct) else np.zeros(0)
        total = np.bincount(doc, weights=of_word[place], minlength=len(texts))
        n = np.bincount(doc, weights=sizes[place], minlength=len(texts))
        if len(codes) > 1:
            rows, of = features.pairs(codes, doc)
            total += np.bincount(of, weights=self.logits[rows], minlength=len(texts))
            n += np.bincount(of, minlength=len(texts))
        mean = np.divide(total, n, out=np.zeros(len(texts)), where=n > 0)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def trained(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 5, rate: float = 0.25, seed: int = 7) -> Scorer:
    """Stochastic gradient descent over ``(feature rows, counts, label)``; the rarer label weighs as much as the other.

    A step on the vectors is divided by the squared length of the document's feature shares, so that it moves the mean of a
    long text as far as that of a short one.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS))
    output, bias = random.uniform(-0.5, 0.5, (DIMS, 2)), np.zeros(2)
    labels = np.array([s[2] for s in samples], dtype=np.int64)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weight = np.minimum(np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0.0), 4.0)
    shares = [counts / counts.sum() if len(counts) else counts for _, counts, _ in samples]
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in random.permutation(len(samples)).tolist():
            rows, part, label = samples[i][0], shares[i], labels[i]
            now = rate * (1 - done / steps)
            done += 1
            if not len(rows):
                continue
            mean = part @ vectors[rows]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            error = p * weight[label]
            back = output @ error
            output -= now * np.outer(mean, error)
            bias -= now * 0.1 * error
            vectors[rows] -= np.outer((now / (part @ part)) * part, back)
    return Scorer(vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, **fit) -> Scorer:
    """A model of ``labels.quality`` from rows that are not held out.

    The sample is bounded by ``most_rows``: the labelled rows with the smallest hashes of their ids. Their features come to the
    driver as at most 2**16 distinct rows each. Without labelled rows every text scores one half.
    """
    rated = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows).dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.counted(t) for part in cut(batch.column("text")) for t in part.to_pylist()]
            rows, counts = (pa.array([f[k].tolist() for f in found], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), rows, counts], ["doc_id", "quality", "rows", "counts"])

    table = texts.mapInArrow(count, "doc_id bigint, quality int, rows array<int>, counts array<int>").toArrow().sort_by("doc_id")
    samples = [
        (np.array(r, dtype=np.int64), np.array(n, dtype=np.float64), q)
        for q, r, n in zip(table["quality"].to_pylist(), (x.values.to_numpy() for x in table["rows"]), (x.values.to_numpy() for x in table["counts"]))
    ]
    if not samples:
        return Scorer(np.zeros(1 << BITS), 0.0)
    return trained(samples, **fit)


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.3, **fit) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; ``score`` is the probability of quality 1.

    Null and empty texts get the score of a text without features. Repeated rows each get a row, an empty table gives none.
    Only ``doc_id`` and ``text`` of the documents are looked at, and the id for ``held_out`` alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **fit))  # 2**16 numbers

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        yield from each_slice(lambda texts: pa.array(model.value.scores(features, texts), pa.float64()), columns, pa.float64())

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), score.asNondeterministic()("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
