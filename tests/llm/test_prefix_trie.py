"""The prefix trie against plain dictionaries: small blocks and shards, awkward rows, colliding digests."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from askwell.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by.setdefault(conv, []).append(((turn is not None, turn or 0), role, digest, text))
    by = {c: [(x[1], x[3]) for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    rebuilt = {}
    for conv, own in by.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = by.get(conv - conv % 5, [])[:h] + own[h:]
    members, children = {}, {}
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[x] for x in below) or 1
        ends = ",".join(map(str, sorted(c for c in members[node] if len(rebuilt[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def nodes(df, **options):
    return sorted((tuple(r)[:8] for r in trie.prefix_trie(df, **options).collect()), key=lambda r: r[:2])


def some_rows():
    rng, rows = random.Random(3), []
    for conv in [*range(60), 77, 1003]:
        if conv not in (10, 25):  # families without their first conversation
            rows += [(conv, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", None, ""]))
                     for t in range(rng.randint(1, 14))]
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2400, 5) for t in range(9)]  # copies
    return rows + rows[:20] + [(None, 1, "user", "x"), (4001, 0, "user", "long " * 50_000)]


def test_trie_is_that_of_plain_dictionaries(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumn("part", F.lit("x")).withColumn("at", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("depth", F.lit(3))
    want = plain(rows)
    assert nodes(df) == want
    assert nodes(df, block=3, shard_rows=20) == want  # conversations over several blocks, nodes over several shards


def test_colliding_digests_are_hashed_anew(spark, monkeypatch):
    rows, own, used = some_rows()[:200], trie.lanes, []

    def weak(salt):
        used.append(salt)
        a, b = own(salt)
        return (a.bitwiseAND(F.lit(3).cast("bigint")), b.bitwiseAND(F.lit(1).cast("bigint"))) if salt == trie.SALTS[0] else (a, b)

    monkeypatch.setattr(trie, "lanes", weak)
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert trie.SALTS[1] in used


def test_empty_table_and_conversations_without_turns(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, None, None)]  # taken from a conversation that is not there
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert plain(rows)[0][:4] == (lone, 0, None, 1)


def test_slots_are_a_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    digests = trie.distinct(rng.integers(-(2**62), 2**62, (5000, 3)))
    table = trie.SlotTable(digests)
    assert sorted(table.slots(digests).tolist()) == list(range(len(digests)))
    assert (table.slots(digests + 1) == -1).all()
    assert len(trie.SlotTable(digests[:0])) == 0 and (trie.SlotTable(digests[:0]).slots(digests[:3]) == -1).all()
