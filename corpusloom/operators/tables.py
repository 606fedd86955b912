"""Changes to keyed tables as events: nothing is updated in place, the latest event of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import truncate

# The states in which a task is done, and those that a restart interrupts.
TERMINAL = ("succeeded", "failed", "skipped")
WAITING = ("queued", "running")
UNTITLED = "新会话"


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of every key by `order`; a combining aggregation, so that a hot key costs no sort."""
    rest = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return best.select(*keys, "last.*")


def task_states(events: DataFrame, terminal=TERMINAL, waiting=WAITING, restarted: bool = False) -> DataFrame:
    """task_id, status, progress, updated_at, finished_at of each task from its events (task_id, seq, at, status, progress).

    A task that is done has finished when its last event says, or else when that event came; one that isn't done has not
    finished. After a restart, tasks that still wait or run count as failed at their last event. Progress is rounded to
    four places. Tasks with a null id are one task.
    """
    last = latest(events, ["task_id"], ["at", "seq"])
    status = F.when(F.col("status").isin(*waiting), "failed").otherwise(F.col("status")) if restarted else F.col("status")
    given = F.col("finished_at" if "finished_at" in events.columns else "at")
    done = F.col("status").isin(*terminal, *(waiting if restarted else ()))
    return last.select("task_id", status.alias("status"), F.round("progress", 4).alias("progress"), F.col("at").alias("updated_at"), F.when(done, F.coalesce(given, "at")).alias("finished_at"))


def session_titles(messages: DataFrame, titles: DataFrame | None = None, most: int = 30) -> DataFrame:
    """conv_id, title: the given one (conv_id, title), or the first question, cut to `most` characters, where it is missing or blank."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    auto = F.coalesce(F.nullif(truncate(F.col("q"), most), F.lit("")), F.lit(UNTITLED))
    found = messages.select("conv_id").distinct().join(first, "conv_id", "left")
    if titles is None:
        return found.select("conv_id", auto.alias("title"))
    named = F.col("title").isNotNull() & ~F.col("title").isin("", UNTITLED)
    return found.join(titles.select("conv_id", "title"), "conv_id", "left").select("conv_id", F.when(named, F.col("title")).otherwise(auto).alias("title"))


def clear_sessions(messages: DataFrame, cleared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the messages without those of the cleared conversations (conv_id), and conv_id, removed of each of these."""
    ids = cleared.select("conv_id").distinct()
    gone = messages.join(ids, "conv_id", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("removed"))
    removed = ids.join(gone, "conv_id", "left").select("conv_id", F.coalesce("removed", F.lit(0)).alias("removed"))
    return messages.join(ids, "conv_id", "left_anti"), removed


def sessions_touched(sessions: DataFrame, touched: DataFrame) -> DataFrame:
    """sessions (conv_id, title, summary, summarized_upto, updated_at, ..) after touches of the same columns: updated_at
    always counts, the others where they are given; a title has at most 200 characters."""
    new = touched.select("conv_id", *(F.col(c).alias(f"_{c}") for c in ("title", "summary", "summarized_upto", "updated_at")))
    rows = sessions.join(new, "conv_id", "left")
    changed = {c: F.coalesce(f"_{c}", c) for c in ("summary", "summarized_upto", "updated_at")} | {"title": F.coalesce(F.substring("_title", 1, 200), "title")}
    return rows.withColumns(changed).select(sessions.columns)


def sessions_cleared(sessions: DataFrame, cleared: DataFrame) -> DataFrame:
    """sessions after some (conv_id, updated_at) have lost their messages: no summary, nothing summarised, no messages."""
    rows = sessions.join(cleared.select("conv_id", F.col("updated_at").alias("_at")), "conv_id", "left")
    gone = F.col("_at").isNotNull()
    reset = {"summary": F.when(~gone, F.col("summary")), "summarized_upto": F.when(gone, 0).otherwise(F.col("summarized_upto")), "message_count": F.when(gone, 0).otherwise(F.col("message_count")), "updated_at": F.coalesce("_at", "updated_at")}
    return rows.withColumns(reset).select(sessions.columns)


def with_missing_columns(table: DataFrame, schema: StructType) -> DataFrame:
    """`table` with every column of `schema` that it lacks, whatever the case of its name, as nulls; twice is the same as once."""
    have = {c.lower() for c in table.columns}
    return table.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name.lower() not in have))


def as_json(*columns: str) -> Column:
    """A row's columns as one JSON object; null fields are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
