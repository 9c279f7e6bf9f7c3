"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch: round after round, every element of a set is hashed into one of ``bins`` bins with a value that grows with the
round, until each bin holds one; a bin keeps its smallest. Two sketches agree in a bin with a probability of the sets' Jaccard
similarity, concentrated as for as many independent hash functions.

Links are found in two steps. Texts with equal sets are one class. Classes that agree in a band are a bucket; each
bucket's classes are compared with its smallest only. Then the classes of buckets that this left in different components
are compared with each other, bucket by bucket, in blocks of bounded size. Every comparison is made on the full sets, and of the second
kind only links that join components are given out. Texts are only compared where they share a band: six values of the
sketch, which texts of a similarity of 0.8 share with a probability of all but 3 in a million, such of 0.35 with 0.07.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import Codes, cut, mix, written

BANDS, ROWS = 42, 6
BINS = 256  # a power of two, BANDS * ROWS or more
BIN_BITS = BINS.bit_length() - 1
#: Ids of up to so many candidates are sent to all tasks (16 MB); beyond, the texts are shuffled.
MOST_SENT = 1_000_000
#: Words whose hashes a task keeps.
MOST_WORDS = 250_000
#: Classes of a block, and elements of a matrix, in comparisons between components.
BLOCK, COLUMNS = 256, 4096
STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted sets of hashed word shingles."""

    def __init__(self, words: int):
        self.words, self.codes, self.hashes = words, Codes(), np.zeros(0, dtype=np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.codes) > MOST_WORDS:
            self.codes, self.hashes = Codes(), np.zeros(0, dtype=np.uint64)
        lookup, rows = self.codes.__getitem__, []
        for text in texts:
            # bytes: only A-Z change case, and only the six ASCII blanks separate words
            rows.append(list(map(lookup, text.encode("utf-8", "surrogatepass").lower().split())) if text else [])
        fresh = self.codes.fresh()
        if fresh:
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in fresh], dtype=np.uint64)])
        return [self.shingles(self.hashes[row]) for row in rows]

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if not n:
            return hashes
        size = min(self.words, n)
        with np.errstate(over="ignore"):
            folded = mix(hashes[: n - size + 1] + STEP * np.uint64(size))
            for j in range(1, size):
                folded = mix(folded * STEP + hashes[j : n - size + 1 + j])
        return np.unique(folded)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value for each bin; ``elements`` has one or more distinct hashes."""
    bits = np.uint64(64 - (bins.bit_length() - 1))
    edges = np.arange(bins, dtype=np.uint64) << bits
    out, empty = np.zeros(bins, dtype=np.uint64), np.ones(bins, dtype=bool)
    with np.errstate(over="ignore"):
        for turn in range(2 * bins):
            placed = mix(elements + STEP * np.uint64(turn + 1))
            if turn < bins:
                placed.sort()
                at = np.minimum(np.searchsorted(placed, edges), len(placed) - 1)
                found = placed[at]
                hit = empty & (found >> bits == np.arange(bins, dtype=np.uint64))
                out[hit] = found[hit] + np.uint64(turn)
                empty &= ~hit
            elif empty[turn - bins]:  # bins that are still empty get one of the elements for sure
                out[turn - bins], empty[turn - bins] = placed.min() + np.uint64(turn), False
            if not empty.any():
                break
    return mix(out)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = STEP * np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            key = mix(key * STEP + rows[:, j])
    return key.view(np.int64)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands``; no digest and no bands where there is no word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            done = 0
            for part in cut(batch.column("text")):
                sets = shingle(part.to_pylist())
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = [band_keys(sketch(s)) if len(s) else None for s in sets]
                columns = [batch.column("doc_id").slice(done, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                done += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, elements``: the full sets of the documents in ``ids``, as sorted 64-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            done = 0
            for part in cut(batch.column("text")):
                sets = [s.tobytes() for s in shingle(part.to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(part)), pa.array(sets, pa.binary())], ["id", "elements"])
                done += len(part)

    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")
    few = ids.count() <= MOST_SENT
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(work, "id bigint, elements binary")


def alike(percent: int):
    @F.arrow_udf("boolean")
    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right):
            x, y = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
            low, high = sorted((len(x), len(y)))
            if 100 * low < percent * high:
                out.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (low + high - common))
        return pa.array(out, pa.bool_())

    return check


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(sets_of(docs, ids, words), "sets")
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("right")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("left")), "a")
    return both.where(alike(percent)("left", "right")).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node of the edges ``a, b``: the smallest id reachable.

    Large-star and small-star steps (Kiveris and others, 2014) in turn, with minima from aggregates, until all are
    stars. No node's neighbours are gathered; each round is a table in the shared folder.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        ways = pairs.select("a", "b")
        if large:
            ways = ways.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        linked = ways.join(least, "a")
        kept = linked.where("b > a") if large else linked.where("b <> m")
        out = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out if large else out.unionByName(least.select("a", F.col("m").alias("b")))

    def settled(pairs: DataFrame) -> bool:
        """Whether every node hangs on one root, and no root on another."""
        ways = pairs.select(F.col("a").alias("id"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("b").alias("id"), F.lit(0).alias("up")).distinct())
        return not ways.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 OR ups = 1 AND n > 1").take(1)

    down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = written(edges.where("a <> b").select(*down).distinct(), "edges")
    while not settled(now):
        spread = stars(now, True).where("a <> b").select(*down).distinct()
        now = written(stars(spread, False).where("a <> b").select(*down).distinct(), "edges")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def linked_across(members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between different components among ``(id, component, elements)``, as many as join what can be joined.

    Sizes of all intersections come from products of 0/1 matrices, some thousand elements at a time.
    """
    n = len(members)
    sizes = np.array([len(m[2]) for m in members])
    owner = np.repeat(np.arange(n), sizes)
    _, place, often = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True, return_counts=True)
    shared = often[place] > 1
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((n, n), dtype=np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        low, high = np.searchsorted(place, [start, start + COLUMNS])
        part = np.zeros((n, COLUMNS), dtype=np.float32)
        part[owner[low:high], place[low:high] - start] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    root = {c: c for _, c, _ in members}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        x, y = find(members[i][1]), find(members[j][1])
        if x != y:
            root[y] = x
            out.append((members[i][0], members[j][0]))
    return out


def meetings(open_rows: DataFrame) -> DataFrame:
    """Who is compared with whom: ``id, component`` of the members of each block pair (``family, one, two``), from ``key, rep, component``
    of the buckets that hold several components.

    The largest component of a bucket, where members need no comparison among themselves, and all its other members are each dealt into
    blocks of about ``BLOCK``; a task compares the members of two blocks, the second of which may be the first itself. So a task
    is bounded, and the work is in proportion to the pairs that share a bucket.
    """
    people = open_rows.select(F.col("key").alias("family"), "rep", "component")
    counted = people.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = counted.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("family", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / BLOCK).alias("main_blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("blocks"))
    dealt = people.join(main, "family").withColumn("is_main", F.col("component") == F.col("main"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    met = F.when(F.col("is_main"), F.transform(every(F.col("blocks")), lambda s: F.struct(s.alias("one"), (-1 - F.col("block")).alias("two")))).otherwise(F.concat(
        F.transform(every(F.col("blocks")), lambda s: F.struct(F.least(s, F.col("block")).alias("one"), F.greatest(s, F.col("block")).alias("two"))),
        F.transform(every(F.col("main_blocks")), lambda u: F.struct(F.col("block").alias("one"), (-1 - u).alias("two"))),
    ))
    return dealt.select("family", F.col("rep").alias("id"), "component", F.explode(met).alias("m")).select("family", "m.one", "m.two", "id", "component")


def across(docs: DataFrame, open_rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` between components that share buckets; only such that join components of a task go out."""
    groups = meetings(open_rows)
    sets = written(sets_of(docs, open_rows.select(F.col("rep").alias("id")).distinct(), words).distinct(), "sets")

    def compare(table: pa.Table) -> pa.Table:
        ids, of = table["id"].to_pylist(), table["component"].to_pylist()
        members = [(i, c, np.frombuffer(e, dtype=np.uint64)) for i, c, e in zip(ids, of, table["elements"].to_pylist())]
        found = linked_across(members, percent)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return written(groups.join(sets, "id").groupBy("family", "one", "two").applyInArrow(compare, "a bigint, b bigint").distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Null text and text without words: an empty set, linked with nothing. Texts of fewer words than a shingle are one
    shingle. Rows of one id are one node: they share their component, and all are kept if it is their id. A null id is linked
    with nothing and kept. Other columns are not looked at; an empty table gives no row.
    """
    rows = written(sketched(docs, words), "sketches")
    classes = written(
        rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")),
        "classes",
    )
    members = classes.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(buckets, "key"), "buckets")
    star = written(shared.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    first = verified(docs, star, words, percent)
    copies = rows.where("doc_id IS NOT NULL").join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    first = written(first, "links")
    # near enough for the next step: the smallest leader linked, and the smallest linked to that one
    up = first.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("up"))
    above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
    labels = up.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("component"))

    held = shared.where("n > 2").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    held = held.select("key", "rep", F.coalesce("component", "rep").alias("component"))
    members_of = F.min("rep").alias("leader"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who")
    mixed = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *members_of).where("low < high")
    mixed = mixed.groupBy("leader", "n", "who").agg(F.min("key").alias("key")).select("key")  # buckets with the same members are one
    open_rows = written(held.join(mixed, "key").select("key", "rep", "component").distinct(), "open")
    links = first.unionByName(across(docs, open_rows, words, percent)) if open_rows.take(1) else first

    same_id = copies.where("a <> b")
    if copies.distinct().groupBy("b").count().where("count > 1").take(1):  # rows of one id with different texts join the classes of both
        merged = components(links.unionByName(same_id))
        final = rows.select("doc_id", "n_shingles").join(merged.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    else:
        of_class = classes.select("digest", "rep").join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
        of_class = of_class.select("digest", F.coalesce("component", "rep").alias("component"))
        final = rows.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their group; columns as given. Of rows that repeat an id one stays; rows
    without an id all stay."""
    found = written(near_duplicates(docs, words, percent).where("doc_id IS NOT NULL"), "near")
    gone = found.where("NOT kept").select("doc_id").distinct()
    few = gone.count() <= MOST_SENT
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = written(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.take(1):
        return left
    return left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
