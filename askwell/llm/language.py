"""Language of a text as a mixture: expectation-maximisation over n-gram likelihoods, languages chosen by penalised likelihood.

Each language is a distribution over hashed character trigrams of words. A text's trigrams are taken as drawn from a
mixture of languages; EM estimates the shares. Languages are then put in order of share, and the mixture of the
first k is fitted for k = 1, 2, ...; the k of the best likelihood less ``penalty * (k - 1) * log(n)`` is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import each_slice, held_out, mix

BITS = 15
LETTER = re.compile(r"[^\W\d_]")
KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_langs", pa.int64()), ("mixture", pa.map_(pa.string(), pa.float64()))])
SQL_KIND = "struct<lang_pred: string, score: double, n_langs: bigint, mixture: map<string, double>>"
MAX_LANGUAGES = 1000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hashed trigram and count, by document: letters in lower case, all else a word boundary."""
    lowered = [t.lower() for t in texts]
    joined = "\0\0" + "\0\0".join(lowered) + "\0\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    docs = np.repeat(np.arange(len(lowered) + 1), [2] + [len(t) + 2 for t in lowered]) - 1
    kinds = np.unique(points)
    letters = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in kinds.tolist()])
    points[~letters[np.searchsorted(kinds, points)]] = 32
    a, b, c = points[:-2].astype(np.uint64), points[1:-1].astype(np.uint64), points[2:].astype(np.uint64)
    real = (points[1:-1] != 32) & (docs[1:-1] >= 0)
    hashed = mix((a[real] << np.uint64(42)) | (b[real] << np.uint64(21)) | c[real]) >> np.uint64(64 - BITS)
    keys, counts = np.unique((docs[1:-1][real].astype(np.uint64) << np.uint64(BITS)) | hashed, return_counts=True)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), counts


@dataclass
class LanguageModel:
    """``log_p``: trigram by language, natural logarithms."""

    languages: list[str]
    log_p: np.ndarray
    rounds: int = 12
    penalty: float = 4.0

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shares by text and language, and the number of languages taken. A text without letters has no share."""
        n, k_all = len(texts), len(self.languages)
        shares, taken = np.zeros((n, k_all)), np.zeros(n, dtype=np.int64)
        doc, gram, count = grams(texts)
        if not len(doc) or not k_all:
            return shares, taken
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        present, row = doc[starts], np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
        total = np.add.reduceat(count, starts)
        log_p = self.log_p[gram]
        high = log_p.max(axis=1)
        p = np.exp(log_p - high[:, None])

        def fitted(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            theta = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(self.rounds):
                joint = p * theta[row]
                joint *= (count / joint.sum(axis=1))[:, None]
                theta = np.add.reduceat(joint, starts, axis=0) / total[:, None]
            return theta, np.add.reduceat(count * np.log((p * theta[row]).sum(axis=1)), starts)

        theta, _ = fitted(np.ones((len(present), k_all)))
        order = np.argsort(-theta, axis=1, kind="stable")
        single = np.add.reduceat(count[:, None] * (log_p - high[:, None]), starts, axis=0)
        best = single.argmax(axis=1)
        chosen, size = np.eye(k_all)[best], np.ones(len(present), dtype=np.int64)
        best_score = single[np.arange(len(present)), best]
        for k in range(2, k_all + 1):
            # the order of shares is the same for every k, so once a text's k-th share is nothing, more languages cannot help
            if not (theta[np.arange(len(present)), order[:, k - 1]] > 1e-9).any():
                break
            allowed = np.zeros((len(present), k_all))
            np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
            mixed, likely = fitted(allowed)
            score = likely - self.penalty * (k - 1) * np.log(np.maximum(total, 2))
            better = score > best_score
            chosen[better], size[better], best_score[better] = mixed[better], k, score[better]
        shares[present], taken[present] = chosen, size
        return shares, taken

    def predict(self, texts: list[str | None]) -> pa.Array:
        shares, taken = self.mixtures(["" if t is None else t for t in texts])
        found = taken > 0
        top = shares.argmax(axis=1) if self.languages else np.zeros(len(texts), dtype=np.int64)
        rows = []
        for i, t in enumerate(texts):
            if t is None or not LETTER.search(t) or not found[i]:
                rows.append({"lang_pred": "und", "score": 0.0, "n_langs": 0, "mixture": []})
            else:
                mixture = [(self.languages[j], float(shares[i, j])) for j in np.flatnonzero(shares[i] > 0)]
                rows.append({"lang_pred": self.languages[top[i]], "score": min(1.0, float(shares[i, top[i]])), "n_langs": int(taken[i]), "mixture": mixture})
        return pa.array(rows, KIND)


def learn(docs: DataFrame, per_language: int = 2000, smoothing: float = 0.5) -> LanguageModel:
    """Trigram distributions from rows with a language and a text that are not held out.

    The sample is bounded: about ``per_language`` rows of each language, chosen by a hash of the id. Counting is a Spark
    aggregate; what comes to the driver is languages x 2**15 counts at most.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0)))
    shares = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        table = np.zeros((len(languages), 1 << BITS), dtype=np.int64)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for start in range(0, len(texts), 200):
                doc, gram, n = grams(texts[start : start + 200])
                of = np.array([place[x] for x in langs[start : start + 200]])
                np.add.at(table, (of[doc], gram), n)
        lang, gram = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(table[lang, gram])], ["l", "g", "n"])

    counts = picked.select("text", "lang").mapInArrow(count, "l bigint, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), 1 << BITS), smoothing)
    table[counts["l"].to_numpy(), counts["g"].to_numpy()] += counts["n"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).T.copy())


def language_column(model: LanguageModel, text):
    """A struct column: ``lang_pred``, ``score`` (the share of that language), ``n_langs``, ``mixture``."""
    @F.arrow_udf(SQL_KIND)
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each_slice(model.predict, columns, KIND)

    return predict.asNondeterministic()(text)


def languages(docs: DataFrame, **fit) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, n_langs, mixture``.

    Null text, text without a letter, or nothing to learn from: ``und`` with score 0. Ties go to the language first in
    alphabetical order. Repeated rows each get their row; an empty table gives none. Other columns are not looked at.
    """
    found = docs.select("doc_id", "text").withColumn("found", language_column(learn(docs, **fit), F.col("text")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "found.*")


def identified(docs: DataFrame, least: float = 0.5, **fit) -> DataFrame:
    """Documents whose main language is known and has a share of ``least`` or more; columns as given."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = row.withColumn("found", language_column(learn(docs, **fit), F.col("row.text")))
    return found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= least)).select("row.*")
