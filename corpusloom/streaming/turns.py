"""A turn's messages, log and session, written from a stream to several tables, each turn exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import truncate
from corpusloom.operators.tables import UNTITLED, latest
from corpusloom.sources import snapshots

TURNS = "session_id long, user_id long, at timestamp, question string, answer string, intent string"
_TABLES = {
    "messages": "session_id long, at timestamp, place int, role string, content string",
    "qa_logs": "session_id long, user_id long, at timestamp, question string, intent string",
    "sessions": "session_id long, user_id long, at timestamp, title string",
}


def tables_of(turns: DataFrame) -> dict[str, DataFrame]:
    """The rows that turns add to each table; a session's rows are its states, of which the last counts."""
    said = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    title = F.coalesce(F.nullif(truncate(F.col("question"), 30), F.lit("")), F.lit(UNTITLED))
    return {
        "messages": turns.select("session_id", "at", said.alias("m")).select("session_id", "at", "m.*"),
        "qa_logs": turns.select("session_id", "user_id", "at", "question", "intent"),
        "sessions": turns.select("session_id", "user_id", "at", title.alias("title")),
    }


def saver(spark: SparkSession, folder: str, fail_after: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a micro-batch to all tables, then its number to the ledger, which readers go by.

    Every table has a folder per batch. A batch that fails before the ledger is written again over what it left, and
    nobody has read that; one that comes again after the ledger is passed over. fail_after: raise after that table, for
    tests of just this.
    """

    def save(turns: DataFrame, batch: int) -> None:
        version, ledger = snapshots.current(spark, folder)
        if batch <= ledger.get("last", -1):
            return
        turns = turns.persist()
        try:
            for name, rows in tables_of(turns).items():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/seg={batch}")
                if name == fail_after:
                    raise RuntimeError(f"failed after {name}")
        finally:
            turns.unpersist()
        snapshots.commit(spark, folder, version, {"last": batch})

    return save


def persist(turns: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of turns (TURNS) to the tables under `folder` until its input is used up."""
    save = saver(turns.sparkSession, folder)
    return turns.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a table of all batches in the ledger."""
    last = snapshots.current(spark, folder)[1].get("last", -1)
    if last < 0:
        return spark.createDataFrame([], _TABLES[table])
    return spark.read.schema(_TABLES[table] + ", seg int").parquet(f"{folder}/{table}").filter(F.col("seg") <= last).drop("seg")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, user_id, title (of its first question), updated_at of every session."""
    rows = read(spark, folder, "sessions")
    first = rows.groupBy("session_id").agg(F.min_by("title", F.struct("at", "title")).alias("title"))
    last = latest(rows.select("session_id", "user_id", F.col("at").alias("updated_at")), ["session_id"], ["updated_at", "user_id"])
    return last.join(first, "session_id")
