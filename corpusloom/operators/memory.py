"""Long-term memories that merge as they come in: an ordered fold per user, over tables and over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.tables import latest

# How alike two memories are that become one, and how many a user keeps.
COSINE, OVERLAP, MOST = 0.9, 0.85, 60

CANDIDATES = "user_id long, turn long, pos int, content string, category string, importance double, v array<float>"
MEMORIES = "user_id long, memory_id string, content string, category string, importance double, hits int, updated_at long, active boolean"


@dataclass
class Memory:
    memory_id: str
    number: int  #: the order in which a user's memories were made
    content: str
    category: str | None
    importance: float
    hits: int
    updated_at: int
    v: list[float] | None
    active: bool = True


def alike(content: str, v: list[float] | None, other: Memory) -> bool:
    """Equal texts; else near vectors, if both have one of the same length; else texts of nearly the same characters."""
    if content == other.content:
        return True
    if v is not None and other.v is not None and len(v) == len(other.v):
        a, b = np.asarray(v, float), np.asarray(other.v, float)
        return float(a @ b) / ((float(np.linalg.norm(a)) or 1.0) * (float(np.linalg.norm(b)) or 1.0)) >= COSINE
    own, its = set(content), set(other.content)
    return bool(own and its) and len(own & its) / len(own) >= OVERLAP


class Book:
    """A user's active memories, at most `most` after every turn."""

    def __init__(self, memories: list[Memory], made: int = 0, most: int = MOST):
        self.memories, self.made, self.most = memories, made, most

    def turn(self, at: int, candidates: list[tuple[int, str, str | None, float, list[float] | None]]) -> list[Memory]:
        """Takes a turn's candidates (pos, content, category, importance, v) in order; the memories that it changed.

        The memories are looked through by importance, then from the one changed last, then from the one made first; the
        turn's own new ones come last. The first that is alike takes the greater importance. If something new came, what
        exceeds `most` by importance and use (then by time) becomes inactive.
        """
        listed = sorted(self.memories, key=lambda m: (-m.importance, -m.updated_at, m.number))[: self.most]
        changed: dict[str, Memory] = {}
        new = False
        for pos, content, category, importance, v in candidates:
            same = next((m for m in listed if alike(content, v, m)), None)
            if same is not None:
                same.importance, same.updated_at = max(same.importance, importance), at
            else:
                same = Memory(f"{at}-{pos}", self.made, content, category, importance, 0, at, v)
                self.made, new = self.made + 1, True
                self.memories.append(same)
                listed.append(same)
            changed[same.memory_id] = same
        if new and len(self.memories) > self.most:
            self.memories.sort(key=lambda m: (-(m.importance + 0.02 * min(m.hits, 10)), -m.updated_at, m.number))
            for m in self.memories[self.most :]:
                m.active = False
                changed[m.memory_id] = m
            self.memories = self.memories[: self.most]
        return list(changed.values())


def _prepared(candidates: DataFrame) -> DataFrame:
    importance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5))))
    rows = candidates.filter("content IS NOT NULL AND turn IS NOT NULL")
    return rows.select(
        F.col("user_id").cast("long").alias("user_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("pos", F.lit(0)).cast("int").alias("pos"), "content", "category", importance.cast("double").alias("importance"), F.col("v").cast("array<float>").alias("v")
    )


def merged(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """user_id, memory_id, content, category, importance, hits, updated_at, active of all memories that the candidates leave.

    candidates: user_id, turn, pos, content, category, importance, v (may be null). A user's turns are taken in order,
    a turn's candidates by pos (of equal ones, by content). The rows of a user lie behind one another in one partition
    and are read as a stream, with at most `most` memories of the user held, so that a user of any length needs no more
    memory than another; inactive ones are given out at once. An order can't be split, so such a user's rows are one
    task's work.

    Null contents and turns are left out, a null user is a user, a null importance is 0.5. No rows give no memories.
    Other columns are ignored.
    """
    names = [x.split()[0] for x in MEMORIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user: tuple | None = None
        book, at, waiting = Book([], most=most), None, []
        out: list[tuple] = []

        def row(m: Memory) -> tuple:
            return (user[0], m.memory_id, m.content, m.category, m.importance, m.hits, m.updated_at, m.active)

        def turned() -> None:
            if waiting:
                out.extend(row(m) for m in book.turn(at, waiting) if not m.active)
                waiting.clear()

        def emitted() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.bool_()]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for who, turn, pos, content, category, importance, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if user != (who,):
                    turned()
                    out.extend(row(m) for m in book.memories)
                    user, book, at = (who,), Book([], most=most), turn
                if turn != at:
                    turned()
                    at = turn
                waiting.append((pos, content, category, importance, v))
            yield emitted()
            out.clear()
        turned()
        out.extend(row(m) for m in book.memories)
        yield emitted()

    rows = _prepared(candidates)
    return rows.repartition("user_id").sortWithinPartitions("user_id", "turn", "pos", "content").mapInArrow(run, MEMORIES)


def merged_stream(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """The same over a stream of candidates: rows of MEMORIES for every memory that a micro-batch changes; the last row of
    a memory counts (`current`). A user's turns must come in order, from one micro-batch to the next; within one they are
    sorted. The state of a user is its at most `most` active memories."""

    def run(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, held = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        book, changed = Book([Memory(**m) for m in held], made, most), {}
        rows = pd.concat(pages).sort_values(["turn", "pos", "content"])
        for at, own in rows.groupby("turn", sort=True):
            vectors = [None if v is None else [float(x) for x in v] for v in own["v"]]
            taken = zip(own["pos"].tolist(), own["content"], own["category"], own["importance"].tolist(), vectors, strict=True)
            changed |= {m.memory_id: m for m in book.turn(int(at), list(taken))}
        state.update((book.made, json.dumps([asdict(m) for m in book.memories])))
        out = [(key[0], m.memory_id, m.content, m.category, m.importance, m.hits, m.updated_at, m.active) for m in changed.values()]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MEMORIES.split(", ")])

    return _prepared(candidates).groupBy("user_id").applyInPandasWithState(run, MEMORIES, "made int, memories string", "update", GroupStateTimeout.NoTimeout)


def current(changes: DataFrame) -> DataFrame:
    """Of the rows of `merged_stream`, written out, the last one of each memory; inactive ones come last of equal times."""
    return latest(changes.withColumn("_last", ~F.col("active")), ["user_id", "memory_id"], ["updated_at", "_last", "importance"]).drop("_last")


def recalled(memories: DataFrame, chosen: DataFrame) -> DataFrame:
    """`memories` after a recall: those in `chosen` (user_id, memory_id) have one hit more for every time."""
    hits = chosen.groupBy("user_id", "memory_id").agg(F.count(F.lit(1)).alias("_n"))
    names = memories.columns
    rows = memories.join(hits, ["user_id", "memory_id"], "left")
    return rows.withColumn("hits", (F.col("hits") + F.coalesce("_n", F.lit(0))).cast(memories.schema["hits"].dataType)).select(names)


def forgotten(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """`memories` with those whose id is in the first column of `ids` inactive."""
    gone = ids.select(F.col(ids.columns[0]).alias("memory_id")).distinct().withColumn("_gone", F.lit(True))
    rows = memories.join(gone, "memory_id", "left")
    return rows.withColumn("active", F.col("active") & F.col("_gone").isNull()).select(memories.columns)


def listed(memories: DataFrame, most: int = MOST) -> DataFrame:
    """user_id, memory_id, content, importance (three places), hits, rank: a user's active memories, the most important first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("updated_at"), "memory_id")
    rows = memories.filter("active").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return rows.select("user_id", "memory_id", "content", F.round("importance", 3).alias("importance"), "hits", "rank")


def context(messages: DataFrame, summaries: DataFrame, turns: int = 6) -> DataFrame:
    """conv_id, history (role and text of the last 2 * turns messages in order), summary (conv_id, summary; may be null)."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= 2 * turns)
    rows = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))  # 2 * turns rows each
    said: Column = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return rows.join(summaries.select("conv_id", "summary"), "conv_id", "left").select("conv_id", said.alias("history"), "summary")
