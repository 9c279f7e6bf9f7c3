"""Scoring every question against every row of its list, keeping only the best k.

Exact search has to look at |questions| x |rows| scores. They are never rows of a DataFrame: a task
scores one Arrow batch of rows against one bounded block of questions as a matrix and keeps k per
question. Two ways get the blocks to the rows:

* few questions (counted first): the block is broadcast and the corpus is scanned once, with no shuffle
  of the corpus;
* else: rows and questions are cut into cells of bounded weight and work (list, row chunk, question block), and
  cells are co-grouped. A hot list only means more cells.

Within a task, a cell or batch is worked off in tiles of questions and rows; between tiles only k rows a question are held.

Both give the same rows; a window over the survivors makes the final cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.operators.ranking import top_k
from askwell.session import shared_folder

MAX_BROADCAST = 4096            # questions sent to every task
MAX_BROADCAST_WEIGHT = 2**22    # array entries of all those questions
MAX_HITS_BROADCAST = 500_000    # hits that joins may broadcast
CELL_WEIGHT = 2**22             # array entries of a cell's rows, and of its questions
CELL_PAIRS = 2**32              # scores of a cell
CELL_HITS = 2**20               # hits of a cell
MOST_TASKS = 1000               # of the cells
MATRIX_ENTRIES = 4_000_000      # scores held at once
QUESTIONS_HELD = 1024           # questions scored together
MANY_QUESTIONS = 256            # from here on, rows a scorer can't tell apart are put together first

# scorer(questions: pa.Table, rows: pa.Table, k, least) -> (question index, row index, distance) candidates that
# hold, for each question, at least its k nearest rows that are no farther than least[question] (inf: any).
Scorer = Callable[[pa.Table, pa.Table, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

HIT = "question_id string, scope string, training_data_type string, id string, distance double"
HIT_SCHEMA = pa.schema([
    ("question_id", pa.string()), ("scope", pa.string()), ("training_data_type", pa.string()),
    ("id", pa.string()), ("distance", pa.float64()),
])


def limit_of(k: dict | int, scope: str | None) -> int:
    return k.get(scope, 0) if isinstance(k, dict) else k


def _first(keys: list[np.ndarray], group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first members of each group by ``keys``, in order of group, and their places from 0."""
    order = np.lexsort((*reversed(keys), group))
    group = group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    kept = place < k
    return order[kept], place[kept]


def _nearest(scorer: Scorer, questions: pa.Table, rows: pa.Table, k: int, least: np.ndarray):
    """The ``k`` best of rows of one scope, which are in order of their ids, for each question: question index, row index, distance.

    Questions and rows are worked off in tiles. After each tile only ``k`` rows of a question stay, as numbers, and
    the last of them says how near a row of the next tiles has to be (``least`` at first).
    """
    found = []
    for at in range(0, questions.num_rows, QUESTIONS_HELD):
        block = questions.slice(at, QUESTIONS_HELD)
        bound = least[at : at + QUESTIONS_HELD].copy()
        step = max(1, MATRIX_ENTRIES // block.num_rows)
        q, r, distance = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for start in range(0, rows.num_rows, step):
            new_q, new_r, new_distance = scorer(block, rows.slice(start, step), k, bound)
            near = ~(new_distance > bound[new_q])
            if not near.any():
                continue
            q, r = np.r_[q, new_q[near]], np.r_[r, new_r[near] + start]
            distance = np.r_[distance, new_distance[near]]
            kept, place = _first([distance, r], q, k)
            q, r, distance = q[kept], r[kept], distance[kept]
            last = place == k - 1
            bound[q[last]] = np.fmin(bound[q[last]], distance[last])
        found.append((q + at, r, distance))
    return tuple(np.concatenate(x) for x in zip(*found))


KEPT = pa.schema([("q", pa.int64()), *list(HIT_SCHEMA)[1:]])


def _hits(
    scorer: Scorer, questions: pa.Table, rows: pa.Table, k: dict | int, same: Callable[[pa.Table], np.ndarray] | None = None,
    kept: pa.Table | None = None,
) -> pa.Table:
    """The k best rows per question, by its index, and scope, of ``rows`` and of what is ``kept`` from earlier ones; ties by id."""
    if not questions.num_rows or not rows.num_rows:
        return KEPT.empty_table() if kept is None else kept
    rows = rows.take(pc.sort_indices(rows["id"])).combine_chunks()
    codes, scopes = pd.factorize(rows["scope"].to_pandas(), use_na_sentinel=False)
    parts = [] if kept is None else [kept]
    for code, scope in enumerate(scopes):
        scope = None if pd.isna(scope) else scope
        take = limit_of(k, scope)
        if take <= 0:
            continue
        members = rows if len(scopes) == 1 else rows.take(pa.array(np.flatnonzero(codes == code)))
        if same is not None and questions.num_rows >= MANY_QUESTIONS and members.num_rows > take:
            # of rows the scorer can't tell apart the first k by id are enough
            first = np.sort(_first([np.arange(members.num_rows)], same(members), take)[0])
            members = members.take(pa.array(first)) if len(first) < members.num_rows else members
        least = np.full(questions.num_rows, np.inf)
        if kept is not None and kept.num_rows:
            mine = pc.is_null(kept["scope"]) if scope is None else pc.fill_null(pc.equal(kept["scope"], scope), False)
            mine = kept.filter(mine)
            before, distance = mine["q"].to_numpy(), mine["distance"].to_numpy()
            full = np.bincount(before, minlength=len(least)) >= take
            farthest = np.full(len(least), -np.inf)
            np.maximum.at(farthest, before, distance)
            least = np.where(full & ~np.isnan(farthest), farthest, least)
        q, r, distance = _nearest(scorer, questions, members, take, least)
        if len(q):
            hit = members.select(["scope", "training_data_type", "id"]).take(pa.array(r))
            parts.append(pa.table([pa.array(q), *(hit[c].cast(pa.string()) for c in hit.column_names), pa.array(distance)], schema=KEPT))
    if kept is None:  # one cut per scope was enough
        return pa.concat_tables(parts) if parts else KEPT.empty_table()
    return kept if len(parts) == 1 else _cut(pa.concat_tables(parts).combine_chunks(), k)


def _cut(hits: pa.Table, k: dict | int) -> pa.Table:
    codes, scopes = pd.factorize(hits["scope"].to_pandas(), use_na_sentinel=False)
    place_of_id = np.empty(hits.num_rows, dtype=np.int64)
    place_of_id[pc.sort_indices(hits["id"]).to_numpy()] = np.arange(hits.num_rows)
    limits = np.array([limit_of(k, None if pd.isna(x) else x) for x in scopes], dtype=np.int64)
    group = hits["q"].to_numpy() * max(1, len(scopes)) + codes
    kept, place = _first([hits["distance"].to_numpy(), place_of_id], group, int(limits.max(initial=0)))
    return hits.take(pa.array(kept[place < limits[codes[kept]]]))


def _named(hits: pa.Table, questions: pa.Table) -> pa.Table:
    """Hits with the ids of their questions."""
    ids = questions["question_id"].take(hits["q"]).cast(pa.string())
    return pa.table([ids, *(hits[c] for c in KEPT.names[1:])], schema=HIT_SCHEMA)


def _having(table: pa.Table, column: str | None) -> pa.Table:
    """The rows that have a value in ``column``."""
    return table.filter(pc.is_valid(table[column])) if column is not None and table[column].null_count else table


def _scan(scorer: Scorer, questions: pa.Table, corpus: DataFrame, k: dict | int, same, needs: tuple[str | None, str | None]) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(_having(questions, needs[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = KEPT.empty_table()
        for batch in batches:
            kept = _hits(scorer, shared.value, _having(pa.Table.from_batches([batch]), needs[0]), k, same, kept)
        yield from _named(kept, shared.value).to_batches()

    return corpus.mapInArrow(run, HIT)


def _cells(scorer: Scorer, questions: DataFrame, corpus: DataFrame, k: dict | int, lists: list[str],
           weights: tuple[Column, Column], cell_weight: int, cell_pairs: int, most: int, same, needs: tuple[str | None, str | None]) -> DataFrame:
    def parts(df: DataFrame, weight: Column, name: str, rows: str) -> DataFrame:
        needed = F.ceil(F.coalesce(F.sum(weight), F.lit(0)) / F.lit(float(cell_weight))).cast("int")
        return df.groupBy(*lists).agg(F.greatest(F.lit(1), needed).alias(name), F.count(F.lit(1)).alias(rows))

    def planned(df: DataFrame) -> DataFrame:
        pairs = F.col("_rows").cast("double") * F.col("_asked") / (F.col("_nc") * F.col("_nq"))
        hits = F.col("_asked") * F.lit(float(most)) / F.col("_nq")
        more = F.greatest(F.lit(1), F.ceil(pairs / F.lit(float(cell_pairs))).cast("int"), F.ceil(hits / F.lit(float(CELL_HITS))).cast("int"))
        return df.select(*lists, "_nc", (F.col("_nq") * more).alias("_nq"))

    per_row, per_question = parts(corpus, weights[0], "_nc", "_rows"), parts(questions, weights[1], "_nq", "_asked")
    spark = corpus.sparkSession
    if lists:
        # one short row per list, written since both sides need it
        path = shared_folder(spark, "cells")
        planned(per_row.join(per_question, lists)).write.parquet(path)
        plan = spark.read.parquet(path)
        n_cells = plan.agg(F.sum(F.col("_nc").cast("bigint") * F.col("_nq"))).first()[0] or 1
        with_plan = lambda df: df.join(plan, lists)
    else:
        found = planned(per_row.crossJoin(per_question)).first()  # one row
        n_cells = found["_nc"] * found["_nq"]
        counts = {"_nc": F.lit(found["_nc"]), "_nq": F.lit(found["_nq"])}
        with_plan = lambda df: df.withColumns(counts)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = (
        with_plan(corpus)
        .withColumn("_chunk", F.pmod(F.xxhash64("id"), F.col("_nc")).cast("int"))
        .withColumn("_block", every("_nq")).drop("_nc", "_nq")
    )
    asked = (
        with_plan(questions)
        .withColumn("_block", F.pmod(F.xxhash64("question_id"), F.col("_nq")).cast("int"))
        .withColumn("_chunk", every("_nc")).drop("_nc", "_nq")
    )
    cell = [*lists, "_chunk", "_block"]
    # the number of tasks goes by the work: cells have few bytes for their time, so by bytes they would be put together
    tasks = min(2 * n_cells, MOST_TASKS)
    # questions taken from the corpus have columns of their own, or those both sides share would be missing on one
    asked = asked.select([F.col(c).alias(c) for c in asked.columns])
    rows, asked = rows.repartition(tasks, *cell), asked.repartition(tasks, *cell)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _having(left, needs[0]), _having(right, needs[1])
        return _named(_hits(scorer, right, left, k, same), right)

    return rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, HIT)


def _few(questions: DataFrame, weight: Column, most: int) -> tuple[pa.Table | None, DataFrame]:
    """The questions, if they are few and small enough to be sent to every task; and all of them written, as they are read again
    and may be costly to make."""
    spark = questions.sparkSession
    path = shared_folder(spark, "questions")
    questions.write.parquet(path)
    kept = spark.read.schema(questions.schema).parquet(path)
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("w")).first()
    return kept.toArrow() if size["n"] <= most and size["w"] <= MAX_BROADCAST_WEIGHT else None, kept


def block_search(
    scorer: Scorer, questions: DataFrame, corpus: DataFrame, k: dict | int, weights: tuple[Column, Column], *,
    lists: list[str] | None = None, scopes: int = 1, max_broadcast: int = MAX_BROADCAST,
    cell_weight: int = CELL_WEIGHT, cell_pairs: int = CELL_PAIRS, same: Callable[[pa.Table], np.ndarray] | None = None,
    needs: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """The ``k`` nearest rows per question and scope: question_id, training_data_type, id, distance, rank.

    ``corpus`` needs id, training_data_type and scope, ``questions`` question_id, both what the scorer reads.
    ``weights`` says how many array entries a row and a question have, ``scopes`` how many scopes there are. With ``lists`` a question only meets
    the rows of its own lists. ``same`` numbers rows so that those with one number score alike. ``needs`` names a column
    without which a row and a question take no part: tasks leave them out, since a filter on what a model computes has Spark compute it twice. Hits of few questions are marked small, so that joins send them around and
    not the corpus.
    """
    lists = lists or []
    small, questions = (None, questions) if lists else _few(questions, weights[1], max_broadcast)
    if small is not None:
        found = _scan(scorer, small, corpus, k, same, needs)
    else:
        found = _cells(scorer, questions, corpus, k, lists, weights, cell_weight, cell_pairs, sum(k.values()) if isinstance(k, dict) else k * scopes, same, needs)
    order = [F.asc("distance"), F.asc("id")]
    keys = ["question_id", "scope"]
    if isinstance(k, dict):
        pairs = [F.lit(x) for scope_k in k.items() for x in scope_k]
        limit = F.coalesce(F.create_map(*pairs)[F.col("scope")], F.lit(0))
        most = max(k.values(), default=0)
        hits = top_k(found, keys, order, most).filter(F.col("rank") <= limit)
    else:
        most = k
        hits = top_k(found, keys, order, k)
    hits = hits.drop("scope")
    few = small is not None and small.num_rows * most * scopes <= MAX_HITS_BROADCAST
    return F.broadcast(hits) if few else hits
