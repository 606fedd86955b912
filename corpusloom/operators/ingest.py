"""From files to chunks with failures that stay with their rows: every file ends with a status, a stage and perhaps an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.operators.chunk_store import ChunkStore
from corpusloom.operators.corpus import greedy_dedup, packed_chunks, simhash
from corpusloom.operators.structure import clean_text
from corpusloom.sources.load import file_text
from corpusloom.sources.snapshots import stored

#: Characters of an error's message that are kept.
MOST_MESSAGE = 500


def guarded(rows: DataFrame, stage: str, f: Callable, inputs: list[str], output: str, kind: str) -> DataFrame:
    """`rows` (with columns stage and error) with output = f(*inputs), of rows that have no error yet.

    What f raises becomes the row's error, with this stage; the task goes on. Rows that have failed before pass by
    untouched, with a null output.
    """
    names = rows.columns
    field = StructField(output, _parse_datatype_string(kind))
    schema = StructType([x for x in rows.schema.fields if x.name != output] + [field])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            stages, errors, out = columns["stage"].to_pylist(), columns["error"].to_pylist(), []
            taken = [columns[c] for c in inputs]
            for i, failed in enumerate(errors):
                value = None
                if failed is None:
                    try:
                        value = f(*(c[i].as_py() for c in taken))
                    except Exception as e:  # noqa: BLE001 - whatever a file does to a stage is that file's error
                        stages[i], errors[i] = stage, f"{type(e).__name__}: {e}"[:MOST_MESSAGE]
                out.append(value)
            columns |= {"stage": pa.array(stages, pa.string()), "error": pa.array(errors, pa.string()), output: pa.array(out, arrow.field(output).type)}
            yield pa.RecordBatch.from_arrays([columns[x.name].cast(arrow.field(x.name).type) for x in schema.fields], schema=arrow)

    return rows.mapInArrow(run, schema)


def ingest(files: DataFrame, policy: str = "skip", store: ChunkStore | None = None, parse: Callable = file_text) -> DataFrame:
    """doc_id, name, status, stage, error, original, n_chars, n_chunks of every file (doc_id, name, content).

    Stages: parsing (`parse` of name and bytes), cleaning, deduplicating (policy skip: a file near an earlier one that
    stays is skipped; keep: none is), splitting, and with a store indexing, all at once. A file that fails in a stage
    has status failed, that stage and its error, and isn't in later ones; no failure ends the job. Skipped and succeeded
    files have stage finished. Ids are unique; a null id fails, as does a null content.
    """

    def parsed(doc_id, name, content):
        if doc_id is None:
            raise ValueError("no id")
        if content is None:
            raise ValueError("no content")
        return parse(name or "", bytes(content))

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), "name", "content", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"))
    rows = stored(guarded(rows, "parsing", parsed, ["doc_id", "name", "content"], "text", "string").drop("content"))
    clean = clean_text(rows.filter("error IS NULL").select("doc_id", "text")).select("doc_id", F.col("cleaned").alias("text"))
    good = stored(clean.filter("trim(text) <> ''"))
    kept = good.select("doc_id", F.lit(True).alias("kept"))
    if policy == "skip":
        kept = stored(greedy_dedup(simhash(good, characters=True)))
    fresh = good.join(kept.filter("kept").select("doc_id"), "doc_id", "left_semi")
    chunks = packed_chunks(fresh).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    if store is not None:
        store.put(fresh)
    found = rows.drop("text").join(good.select("doc_id", F.length("text").alias("n_chars")), "doc_id", "left").join(kept, "doc_id", "left").join(chunks, "doc_id", "left")
    failed = lambda stage, error: F.struct(F.lit("failed").alias("status"), stage.alias("stage"), error.alias("error"))
    done = lambda status: F.struct(F.lit(status).alias("status"), F.lit("finished").alias("stage"), F.lit(None).cast("string").alias("error"))
    end = (
        F.when(F.col("error").isNotNull(), failed(F.col("stage"), F.col("error")))
        .when(F.col("n_chars").isNull(), failed(F.lit("cleaning"), F.lit("no text is left after cleaning")))
        .when(~F.col("kept"), done("skipped"))
        .when(F.col("n_chunks").isNull(), failed(F.lit("splitting"), F.lit("no chunks")))
        .otherwise(done("succeeded"))
    )
    return found.select("doc_id", "name", end.alias("e"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")).select("doc_id", "name", "e.*", "n_chars", "n_chunks")
