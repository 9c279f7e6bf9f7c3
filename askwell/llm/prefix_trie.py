"""The trie of conversations that begin alike, counted in tables of nodes that are addressed by minimal perfect hashes.

A node is a distinct sequence of first turns; its digest is the exclusive-or of hashes of (place, turn), so digests
of long conversations come from blocks that are worked off apart. Distinct digests are enumerated first; a
digest that stands for two different prefixes is found there (equal parents and equal last turns are asked for), and
everything is hashed anew with another salt. Then each shard puts the digests of its conversations into the
slots of a minimal perfect hash, checks what stands in each slot, scatters counts into flat arrays, and adds each node's
totals to its parent's slot, deepest nodes first. A total is a sum over the conversations below a node: shards may be
cut anywhere between conversations, and their tables are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwell.llm.common import join_skewed, mix, ranges, written

#: Turns of a conversation that are worked on together, at most.
BLOCK = 4096
#: Rows of a shard's table, about.
SHARD_ROWS = 400_000
#: Ids of one piece of a list that is hashed.
PIECE_IDS = 500
#: Fixed by the contract of the query: conversations of one family are c - c % 5, and take over up to 8 turns.
FAMILY, MOST_TAKEN = 5, 8
SALTS = (11, 23, 37)
KEY = ["depth", "k1", "k2"]
TABLE = ("depth bigint, k1 bigint, k2 bigint, n_convs bigint, conv_id bigint, saved bigint, leaves bigint, "
         "children bigint, parent bigint")
NONE = np.iinfo(np.int64).min


class SlotTable:
    """Slots 0..n-1 for n distinct digests, by levels of bits: at each level the digests that are alone in their place
    stay, the others go on to the next level. A digest's slot is the rank of its bit; the digest found there must be
    its own."""

    def __init__(self, digests: np.ndarray):
        """``digests``: distinct rows of three 64-bit numbers."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, done = digests, 0
        while len(rest):
            place = self.places(rest, len(self.levels), 2 * len(rest))
            alone = np.bincount(place, minlength=2 * len(rest)) == 1
            self.levels.append((alone, done + np.cumsum(alone) - 1))
            done += int(alone.sum())
            rest = rest[~alone[place]]
        self.digests = np.zeros((done, 3), dtype=np.int64)
        self.digests[self.ranks(digests)] = digests

    @staticmethod
    def places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        a, b, c = (digests[:, i].astype(np.uint64) for i in range(3))
        return (mix(a + mix(b + mix(c + np.uint64(level + 1)))) % np.uint64(size)).astype(np.int64)

    def ranks(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, dtype=np.int64)
        left = np.arange(len(digests))
        for level, (bits, rank) in enumerate(self.levels):
            place = self.places(digests[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return out

    def __len__(self) -> int:
        return len(self.digests)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that are not in the table."""
        found = self.ranks(digests)
        same = (found >= 0) & (self.digests[found] == digests).all(axis=1) if len(self) else np.zeros(len(found), bool)
        return np.where(same, found, -1)


def distinct(digests: np.ndarray) -> np.ndarray:
    ordered = digests[np.lexsort(digests.T)]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return ordered[new]


def shard_table(rows: dict[str, np.ndarray], block: int) -> dict[str, np.ndarray]:
    """Totals of a shard's nodes, one row per slot. The rows of a conversation's block come whole; the first turn of a
    block has no parent here, as what comes after a block is already in the row that ends it."""
    digests = np.stack([rows["depth"], rows["k1"], rows["k2"]], axis=1)
    table = SlotTable(distinct(digests))
    slot = table.slots(digests)
    if (slot < 0).any():
        raise AssertionError("a digest without a slot")
    inner = (rows["depth"] - 1) % block != 0
    above = np.full(len(slot), -1, dtype=np.int64)
    above[inner] = table.slots(np.stack([rows["depth"] - 1, rows["p1"], rows["p2"]], axis=1)[inner])
    if (above[inner] < 0).any():
        raise AssertionError("a parent without a slot")
    parent_slot = np.full(len(table), -1, dtype=np.int64)
    parent_slot[slot] = above
    count, saved, leaves, children = np.zeros((4, len(table)), dtype=np.int64)
    np.add.at(count, slot, 1)
    for to, name in ((saved, "saved"), (leaves, "leaves"), (children, "children")):
        np.add.at(to, slot, rows[name])
    first, parent = np.full(len(table), np.iinfo(np.int64).max), np.full(len(table), NONE)
    np.minimum.at(first, slot, rows["conv_id"])
    np.maximum.at(parent, slot, rows["parent"])
    depth = table.digests[:, 0]
    by_depth = np.argsort(-depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        level = level[parent_slot[level] >= 0]
        np.add.at(saved, parent_slot[level], saved[level])
        np.add.at(leaves, parent_slot[level], leaves[level])
    return {"depth": depth, "k1": table.digests[:, 1], "k2": table.digests[:, 2], "n_convs": count, "conv_id": first,
            "saved": saved, "leaves": leaves, "children": children, "parent": parent}


def shards(block: int, shard_rows: int):
    """Rows sorted by conversation and block are cut into shards between two blocks."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            found = shard_table(rows, block)
            arrays = {k: pa.array(v, pa.int64(), mask=v == NONE if k == "parent" else None) for k, v in found.items()}
            return pa.RecordBatch.from_pydict(arrays)

        held: list[dict[str, np.ndarray]] = []
        count = 0
        for batch in batches:
            rows = {n: pc.fill_null(c, NONE).to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}
            if not len(rows["depth"]):
                continue
            if count >= shard_rows:
                starts = np.r_[
                    bool(rows["conv_id"][0] != held[-1]["conv_id"][-1] or rows["block"][0] != held[-1]["block"][-1]),
                    (np.diff(rows["conv_id"]) != 0) | (np.diff(rows["block"]) != 0),
                ]
                if starts.any():
                    at = int(np.argmax(starts))
                    held.append({k: v[:at] for k, v in rows.items()})
                    yield out({k: np.concatenate([x[k] for x in held]) for k in rows})
                    held, count, rows = [], 0, {k: v[at:] for k, v in rows.items()}
            held.append(rows)
            count += len(rows["depth"])
        if held:
            yield out({k: np.concatenate([x[k] for x in held]) for k in held[0]})

    return tables


def in_order(conversations: DataFrame) -> DataFrame:
    """Turns with their place in their conversation, as far as their range of the sorted turns tells: ``part`` is the
    range, ``at`` the place within it. A conversation of any length may cover many ranges. Texts stay where they are:
    only their SHA-256 and size are sorted. Equal turn numbers go by role and then by that digest."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "role", "digest", "tie"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            new, row = np.r_[ids[0] != last, np.diff(ids) != 0], np.arange(len(ids))
            runs = row - np.maximum.accumulate(np.where(new, row, -seen))
            last, seen = ids[-1], int(runs[-1]) + 1
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(ids), part), pa.int32()), "conv_id": batch.column("conv_id"), "at": pa.array(runs, pa.int64()),
                "digest": batch.column("digest"), "bytes": batch.column("bytes")})

    kind = "part int, conv_id bigint, at bigint, digest binary, bytes bigint"
    n = ranges(conversations.sparkSession, conversations.count(), SHARD_ROWS)
    return slim.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, kind)


def rebuilt(turns: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``, ``length``), and their rebuilt turns: up to h of the first turns of the family's first
    conversation, then the conversation's own turns from place h on."""
    per_part = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    per_part = written(per_part.withColumn("before", before), "trie-parts")
    carry = per_part.filter("before > 0").select("part", "conv_id", "before")  # one for each range at most
    placed = turns.join(F.broadcast(carry), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "bytes")

    convs = per_part.groupBy("conv_id").agg(F.sum("n").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"),
        (F.crc32(F.col("conv_id").cast("string")) % (MOST_TAKEN + 1)).alias("h"))
    firsts = convs.select(F.col("conv_id").alias("family"), F.least("n", F.lit(MOST_TAKEN)).alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(firsts, "family", "left").withColumn("taken", taken)
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "n", "family", "h", "taken", "length"), "trie-convs")

    stretch = F.floor(F.col("place") / block)
    stretches = convs.select("conv_id", "h", "taken", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("stretch"))
    own = placed.withColumn("stretch", stretch).join(stretches, ["conv_id", "stretch"]).filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "length", "digest", "bytes")
    heads = placed.filter((F.col("place") < MOST_TAKEN) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family")
    heads = heads.join(convs, "family").filter("place < h")
    heads = heads.select("conv_id", (F.col("place") + 1).alias("depth"), "length", "digest", "bytes")
    return convs.select("conv_id", "length"), own.unionByName(heads)


def lanes(salt: int) -> tuple[Column, Column]:
    """Two hashes of a turn at its place."""
    return F.xxhash64(F.lit(salt), "depth", "digest"), F.xxhash64("depth", "digest", F.lit(salt + 1))


def paths(turns: DataFrame, salt: int, block: int) -> DataFrame:
    """Each rebuilt turn with the digest of the prefix that it ends (``k1``, ``k2``)."""
    m1, m2 = lanes(salt)
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    held = turns.withColumn("block", F.floor((F.col("depth") - 1) / block)).withColumn("m1", m1).withColumn("m2", m2)
    held = written(held.select("conv_id", "block", "depth", "length", "digest", "bytes", F.bit_xor("m1").over(within).alias("k1"), F.bit_xor("m2").over(within).alias("k2")), "trie-paths")
    short, long = held.filter(F.col("length") <= block), held.filter(F.col("length") > block)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = long.filter(F.col("depth") % block == 0)
    carry = ends.select("conv_id", (F.col("block") + 1).alias("block"), "k1", "k2")
    upto = Window.partitionBy("conv_id").orderBy("block")
    carry = carry.select("conv_id", "block", F.bit_xor("k1").over(upto).alias("c1"), F.bit_xor("k2").over(upto).alias("c2"))
    long = long.join(carry, ["conv_id", "block"], "left").select(
        "conv_id", "block", "depth", "length", "digest", "bytes",
        F.col("k1").bitwiseXOR(F.coalesce("c1", F.lit(0).cast("bigint"))).alias("k1"),
        F.col("k2").bitwiseXOR(F.coalesce("c2", F.lit(0).cast("bigint"))).alias("k2"))
    m1, m2 = lanes(salt)
    return short.unionByName(long).withColumn("p1", F.col("k1").bitwiseXOR(m1)).withColumn("p2", F.col("k2").bitwiseXOR(m2))


def enumerated(rows: DataFrame) -> DataFrame:
    """Distinct prefix digests, each with its smallest conversation, whether no conversation goes on from it, and
    whether all its rows agree on the last turn and on the prefix before."""
    agree = F.lit(True)
    for x in ("digest", "p1", "p2"):
        agree = agree & (F.min(x) == F.max(x))
    return written(rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        (F.max("length") == F.col("depth")).alias("leaf"), agree.alias("agree")), "trie-nodes")


def owners(nodes: DataFrame, first_conv: int | None) -> DataFrame:
    """Where a conversation is the smallest one it is so from some depth (``since``) to its end: that depth, whether its
    end is a leaf, and the smallest conversation of the node above."""
    top = F.min(F.struct("depth", "p1", "p2"))
    tops = written(nodes.groupBy("conv_id").agg(top.alias("top"), F.max("leaf").alias("leaf")).select(
        "conv_id", "leaf", F.col("top.depth").alias("since"), (F.col("top.depth") - 1).alias("depth"), F.col("top.p1").alias("k1"), F.col("top.p2").alias("k2")), "trie-tops")
    parents = nodes.select(*KEY, F.col("conv_id").alias("parent"))
    at_root = tops.filter("since = 1").withColumn("parent", F.lit(first_conv).cast("bigint"))
    below = join_skewed(tops.filter("since > 1"), parents, KEY)
    cols = ["conv_id", "leaf", "since", "parent"]
    return written(at_root.select(*cols).unionByName(below.select(*cols)), "trie-owners")


def end_hashes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """For each node at which conversations end, the SHA-256 of their ids in order. Sorted ids are joined into pieces
    range by range; one task then feeds a node's pieces to the hash, one after the other, and holds none of them."""
    zero = F.lit(0).cast("bigint")
    ids = rows.filter("depth = length").select(*KEY, "conv_id")
    ids = ids.unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.stack([batch.column(k).to_numpy() for k in KEY], axis=1)
            new = np.r_[True, (np.diff(a, axis=0) != 0).any(axis=1)]
            runs = np.flatnonzero(new)
            starts = np.concatenate([np.arange(s, e, PIECE_IDS) for s, e in zip(runs, np.r_[runs[1:], len(a)])])
            text = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(a)], pa.int32()), batch.column("conv_id").cast(pa.string()))
            yield pa.RecordBatch.from_pydict({k: pa.array(a[starts, i]) for i, k in enumerate(KEY)} | {
                "first": batch.column("conv_id").take(pa.array(starts)), "ids": pc.binary_join(text, ",")})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = []
            for d, a, b, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, a, b) != key:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = (d, a, b), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip([*KEY, "ends_sha256"], map(list, zip(*found)))))
        if key is not None:
            yield pa.RecordBatch.from_pydict(dict(zip([*KEY, "ends_sha256"], [[x] for x in (*key, state.hexdigest())])))

    order = [*KEY, "conv_id"]
    n = ranges(rows.sparkSession, convs.count(), SHARD_ROWS)
    cut = ids.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pieces, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    cut = cut.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return cut.mapInArrow(hashes, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``; further columns ``k1``, ``k2`` are the node's digest.

    Rows without a conversation's id belong to none and are left out. Null roles and texts are empty; null turns come first;
    turns of one number go by role, then by the SHA-256 of role and text; repeated rows are turns of their own. An empty
    table has no nodes. Other columns are not read.
    """
    turns = written(in_order(conversations), "trie-turns")
    convs, found = rebuilt(turns, block)
    for salt in SALTS:
        rows = paths(found, salt, block)
        nodes = enumerated(rows)
        if nodes.filter(~F.col("agree")).isEmpty():
            break
    else:
        raise ValueError("digests collide under every salt")
    first_conv, n_convs = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    owned = owners(nodes, first_conv)

    last = F.floor((F.col("length") - 1) / block)
    about = convs.filter("length > 0").join(owned, "conv_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    spent = rows.filter(F.col("length") > block).join(about.drop("length"), ["conv_id", "block"])
    repeat = F.coalesce(F.col("depth") < F.col("since"), F.lit(True))
    spent = spent.groupBy("conv_id", "block").agg(F.sum(F.when(repeat, F.col("bytes")).otherwise(0)).alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    spent = spent.select("conv_id", "block", F.sum("saved").over(later).alias("rest"))
    about = about.drop("length").join(spent, ["conv_id", "block"], "left")

    all_rows = rows.join(about, ["conv_id", "block"])
    ends_block = (F.col("depth") == F.col("length")) | (F.col("depth") % block == 0)
    own = ~repeat
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    all_rows = all_rows.select(
        "conv_id", "block", "depth", "k1", "k2", "p1", "p2",
        (F.when(repeat, F.col("bytes")).otherwise(zero) + F.when(ends_block, F.coalesce("rest", zero)).otherwise(zero)).alias("saved"),
        F.when(ends_block & F.coalesce("leaf", F.lit(False)), one).otherwise(zero).alias("leaves"),
        F.when((F.col("depth") < F.col("length")) & F.coalesce(F.col("since") <= F.col("depth") + 1, F.lit(False)), one).otherwise(zero).alias("children"),
        F.when(own, F.when(F.col("depth") > F.col("since"), F.col("conv_id")).otherwise(F.col("parent"))).alias("parent"))
    tables = all_rows.sortWithinPartitions("conv_id", "block", "depth").mapInArrow(shards(block, shard_rows), TABLE)
    summed = written(tables.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "trie-sums")
    root = summed.filter("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), zero), one).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    root = root.filter(F.lit(n_convs > 0)).select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(first_conv).cast("bigint").alias("conv_id"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n_convs).cast("bigint").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    out = summed.unionByName(root).join(end_hashes(rows, convs), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "k1", "k2")
