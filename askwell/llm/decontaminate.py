"""Benchmark passages in documents, re-parameterised ones too, by windows of canonical templates.

A text becomes a sequence of template tokens: words in lower case, and typed placeholders for numbers, for units after a
number and for names (capitalised words inside a sentence). Windows of ``window`` template tokens of the benchmark
are hashed and joined to those of the documents. A capitalised word is a name or not by what stands before it, so windows
with names as plain words are hashed too, and a word that begins a sentence of the benchmark is read both ways: a copy is
found after ``Question:``, in lower case and without punctuation. Windows of few words are hashed by their real values; an
item shorter than a window is one window as long as itself.

For each window found, the values in its slots are compared. Numbers and units are free, as equal ones may stand for different
things; one name of the item must stand for one name of the document throughout, so a question with other numbers or names
is caught, and a chance agreement of templates with names filled in at random is not. Windows whose values are all the item's
own count whatever the others hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import Codes, cut, mix, ragged, written

WINDOW = 8
#: A window with fewer words that are no placeholders is compared by its real values.
LEAST_WORDS = 4
MOST_WORDS = 250_000
#: Units that follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd mile miles g kg mg lb lbs oz ton tons ml l litre litres liter liters s sec secs second seconds "
    "min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent dollar dollars euro euros "
    "cent cents usd eur gbp mph kmh degree degrees celsius fahrenheit kw kwh watt watts volt volts gb mb kb hz khz mhz ghz".split()
)
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|%|[.!?]|[-+*/=<>^×÷−]")
SIGNS = "-+*/=<>^×÷−"
WORD, NUMBER, UNIT, NAME, STOP, SIGN = range(6)
PLACEHOLDERS = ("", "<number>", "<unit>", "<name>")
STEP = np.uint64(0x9E3779B97F4A7C15)
BLOOM_BITS = 24
#: Contaminated ids up to so many are sent to all tasks (16 MB); beyond, documents are shuffled.
MOST_SENT = 1_000_000
HITS = "at bigint, hash bigint, strong boolean, tokens array<string>, slots array<string>"


def kind_of(token: str) -> int:
    if token in ".!?":
        return STOP
    if token in SIGNS:
        return SIGN
    if token[0].isdigit():
        return NUMBER
    if token.lower() in UNITS:
        return UNIT
    return NAME if token[0] != token[0].lower() and token[1:] == token[1:].lower() else WORD


class Templates:
    """Template tokens of texts. What a blank-separated word consists of is worked out once per word and worker."""

    def __init__(self, window: int):
        self.window = window
        self.placeholders = np.array([0] + [xxhash.xxh3_64_intdigest(p) for p in PLACEHOLDERS[1:]], dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        self.codes, self.values = Codes(), []
        self.hashes, self.kinds = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8)
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)

    def learn(self) -> None:
        found = [TOKEN.findall(word) for word in self.codes.fresh()]
        tokens = list(chain.from_iterable(found))
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        low = [t.lower() for t in tokens]
        self.values.extend(low)
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in low], dtype=np.uint64)])
        self.kinds = np.concatenate([self.kinds, np.array([kind_of(t) for t in tokens], dtype=np.int8)])

    def __call__(self, texts: list[str | None]):
        """Of all texts' tokens: text number, place in the text, kind, value number, value number of the sign before a token
        where one of its neighbours is a number (-1: none), and whether it is a capitalised word that begins a sentence. A
        sentence or a line begins without a name; a unit is one after a number only."""
        if len(self.codes) > MOST_WORDS:
            self.forget()
        lookup = self.codes.__getitem__
        rows = [list(map(lookup, text.replace("\n", " . ").split())) if text else [] for text in texts]
        if self.codes.new:
            self.learn()
        codes = np.fromiter(chain.from_iterable(rows), np.int64)
        lengths = self.lengths[codes]
        token = ragged(self.starts[codes], lengths)
        doc = np.repeat(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), lengths)
        kind = self.kinds[token]
        sign = np.full(len(doc), -1)
        after = np.flatnonzero((kind[:-1] == SIGN) & (doc[1:] == doc[:-1])) + 1
        sign[after] = token[after - 1]
        real = kind != SIGN
        doc, token, kind, sign = doc[real], token[real], kind[real], sign[real]
        first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, dtype=bool)
        before = np.r_[np.int8(STOP), kind[:-1]] if len(doc) else kind
        before = np.where(first, STOP, before)
        sign[(kind != NUMBER) & (before != NUMBER)] = -1
        begins = (kind == NAME) & (before == STOP)
        kind = np.where(((kind == UNIT) & (before != NUMBER)) | begins, WORD, kind)
        real = kind != STOP
        doc, token, kind, sign, begins = doc[real], token[real], kind[real], sign[real], begins[real]
        starts = np.searchsorted(doc, np.arange(len(rows)))
        return doc, np.arange(len(doc)) - starts[doc], kind, token, sign, begins

    @staticmethod
    def folded(first: np.ndarray, rest: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
        """Hashes of the stretches of each size, along the last axis; ``first`` hashes a stretch's first token, ``rest`` its others."""
        n, out = first.shape[-1], {}
        with np.errstate(over="ignore"):
            hashed = mix(first + STEP)
            for j in range(1, min(max(sizes, default=0), n) + 1):
                if j in sizes:
                    out[j] = hashed
                if j < n:
                    hashed = mix(hashed[..., : n - j] * STEP + rest[..., j:])
        return out

    def windows(self, texts: list[str | None], sizes: list[int] | None = None, maybe=None) -> list[tuple]:
        """``(text number, place, hash, strong, template, values)`` of the windows of these sizes that ``maybe`` lets through.

        Without sizes the texts are items: windows are as long as the item where it is shorter, and words that begin
        sentences are read as names, too. ``strong`` windows have enough words beside all placeholders.
        """
        doc, place, kind, token, sign, begins = self(texts)
        whole = np.minimum(np.bincount(doc, minlength=len(texts)), self.window)
        of_items = sizes is None
        sizes = sorted(set(whole.tolist()) - {0}) if of_items else sizes
        least = min(LEAST_WORDS, self.window)
        raw = self.hashes[token]
        plain = np.where(kind == NUMBER, self.placeholders[NUMBER], raw)
        template = np.where(kind == WORD, raw, self.placeholders[np.minimum(kind, NAME)])
        with np.errstate(over="ignore"):
            signed = np.where(sign < 0, raw, mix(raw * STEP + self.hashes[sign])) if (sign >= 0).any() else raw
        kinds = [self.folded(raw, signed, sizes), self.folded(plain, plain, sizes), self.folded(template, template, sizes)]
        counted = [np.r_[0, np.cumsum(x)] for x in (kind == WORD, kind == NUMBER, (kind == UNIT) | (kind == NAME))]
        out = []
        for size in sizes:
            n = len(doc) - size + 1
            if n <= 0:
                continue
            inside = doc[:n] == doc[size - 1 :]
            if of_items:
                inside &= whole[doc[:n]] == size
            n_words, n_numbers, n_others = (c[size:] - c[:-size] for c in counted)
            few, strong = size - n_numbers < least, n_words >= least
            for how, fit in enumerate((inside & few, inside & ~few, inside & strong & (n_others > 0))):
                chosen, hashed = np.flatnonzero(fit), kinds[how][size]
                if maybe is not None:
                    chosen = chosen[maybe(hashed[chosen])]
                for i in chosen.tolist():
                    values = [self.values[t] for t in token[i : i + size].tolist()]
                    if how == 0:
                        signs = ["" if t < 0 or not j else self.values[t] for j, t in enumerate(sign[i : i + size].tolist())]
                        tokens = [x + v for x, v in zip(signs, values)]
                    else:
                        tokens = [PLACEHOLDERS[k] if k == NUMBER or how == 2 and k != WORD else v for k, v in zip(kind[i : i + size].tolist(), values)]
                    out.append((int(doc[i]), int(place[i]), int(hashed[i : i + 1].view(np.int64)[0]), bool(strong[i]), tokens, values))
            if of_items:
                for i in np.flatnonzero(inside & strong).tolist():
                    out.extend(self.read_as_names(i, size, doc, place, kind, token, begins, template, int(n_words[i]) - least))
        return out

    def read_as_names(self, i: int, size: int, doc, place, kind, token, begins, template, most: int) -> Iterator[tuple]:
        """The window at ``i`` with up to ``most`` of the words that begin sentences read as names."""
        at = np.flatnonzero(begins[i : i + size]).tolist()
        values = [self.values[t] for t in token[i : i + size].tolist()]
        for read in chain.from_iterable(combinations(at, k) for k in range(1, min(len(at), most) + 1)):
            hashed, tokens = template[i : i + size].copy(), [PLACEHOLDERS[k] or v for k, v in zip(kind[i : i + size].tolist(), values)]
            hashed[list(read)] = self.placeholders[NAME]
            for j in read:
                tokens[j] = PLACEHOLDERS[NAME]
            yield int(doc[i]), int(place[i]), int(self.folded(hashed, hashed, [size])[size].view(np.int64)[0]), True, tokens, values


class Sieve:
    """A Bloom filter of a fixed number of bits: two stretches of a hash are its places. Its size does not grow with the
    benchmark; with very many items it only lets more windows through to the join."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(hashes: DataFrame) -> Sieve:
        low = F.lit((1 << BLOOM_BITS) - 1).cast("bigint")
        places = F.array(F.col("hash").bitwiseAND(low), F.shiftrightunsigned("hash", BLOOM_BITS).bitwiseAND(low))
        bits = hashes.select(F.explode(places).alias("p")).select(F.shiftrightunsigned("p", 5).alias("word"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
        filled = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**19 rows at most
        words = np.zeros(1 << (BLOOM_BITS - 5), dtype=np.uint32)
        words[filled["word"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint32)
        return Sieve(words)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that may be in the set."""
        maybe = np.arange(len(hashes))
        for shift in (0, BLOOM_BITS):
            p = (hashes[maybe] >> np.uint64(shift)) & np.uint64((1 << BLOOM_BITS) - 1)
            maybe = maybe[(self.words[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & 1 == 1]
        return maybe


def found_windows(rows: DataFrame, key: str, window: int, sizes: list[int] | None = None, maybe: Sieve | None = None) -> DataFrame:
    """``key, at, hash, strong, tokens, slots`` of the windows of ``rows``' texts; without sizes, those of items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(window)
        for batch in batches:
            done, keys = 0, batch.column(key)
            for part in cut(batch.column("text")):
                out = templates.windows(part.to_pylist(), sizes, maybe)
                which, at, hashed, strong, tokens, slots = zip(*out) if out else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(done, len(part)).take(pa.array(which, pa.int64())), pa.array(at, pa.int64()), pa.array(hashed, pa.int64()), pa.array(strong, pa.bool_()),
                     pa.array(tokens, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.string()))],
                    [key, "at", "hash", "strong", "tokens", "slots"],
                )
                done += len(part)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(work, f"{key} {kind}, {HITS}")


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_windows: int = 6) -> DataFrame:
    """``doc_id, item_id, at, n_windows, exact``: benchmark passages in documents, one row for each occurrence.

    An occurrence is ``least_windows`` windows (13 tokens where they are neighbours) in the same alignment, or all strong
    windows, or all windows, of a shorter item. Names must agree one to one, or so many windows hold the item's own values.
    ``at`` is the document's token where it begins; ``exact`` says that all values are the item's own. Texts that are null
    or without a token have none. Repeated items each count; rows of one id are searched each and reported under that id.
    Empty tables give no row; other columns are not looked at.
    """
    items = written(found_windows(benchmark.where("text IS NOT NULL"), "item_id", window), "items")
    places = lambda *of: F.size(F.collect_set(F.when(F.expr(" AND ".join(of) or "true"), F.col("at"))))
    sizes = items.groupBy("item_id").agg(places().alias("of_item"), places("strong").alias("of_strong"))
    lengths = sorted(r["n"] for r in items.select(F.size("tokens").alias("n")).distinct().collect())  # window at most
    hits = written(found_windows(docs.where("text IS NOT NULL"), "doc_id", window, lengths, Sieve.of(items)).drop("strong"), "hits")
    ours = items.select("item_id", F.col("at").alias("item_at"), "hash", "strong", F.col("tokens").alias("item_tokens"), F.col("slots").alias("item_slots"))
    same = hits.join(ours, (hits["hash"] == ours["hash"]) & (F.col("tokens") == F.col("item_tokens")))
    pairs = F.filter(F.arrays_zip(F.col("tokens").alias("t"), F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["t"].isin(*PLACEHOLDERS[1:]))
    lined = same.select("doc_id", "item_id", "at", "strong", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"))
    own = lambda c: F.forall(c, lambda p: p["i"] == p["d"])
    whole = lined.withColumn("own", own("pairs")).groupBy("doc_id", "item_id", "shift").agg(
        F.min("at").alias("at"), places().alias("n_windows"), places("strong").alias("n_strong"), places("own").alias("n_own"),
        places("strong", "own").alias("n_strong_own"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    whole = whole.withColumn("names", F.filter("pairs", lambda p: p["t"] == PLACEHOLDERS[NAME]))
    one_to_one = lambda side: F.size(F.array_distinct(F.col(f"names.{side}"))) == F.size("names")
    enough = lambda n, of: (F.col(of) > 0) & (F.col(n) >= F.least(F.lit(least_windows), F.col(of)))
    long_enough = enough("n_strong", "of_strong") | enough("n_windows", "of_item")
    all_own = enough("n_strong_own", "of_strong") | enough("n_own", "of_item")
    return whole.join(sizes, "item_id").where(long_enough & (all_own | (one_to_one("i") & one_to_one("d")))).select(
        "doc_id", "item_id", "at", F.col("n_windows").cast("bigint").alias("n_windows"), own("pairs").alias("exact")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_windows: int = 6) -> DataFrame:
    """The documents without any benchmark passage; columns as given. Rows of one id stay or go together, null ids are one id."""
    bad = written(contaminations(docs, benchmark, window, least_windows).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    few = bad.count() <= MOST_SENT
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
