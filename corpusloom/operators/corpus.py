"""Cleaning, fingerprints, duplicates and chunk access for document tables."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SENTENCE, hex_to_long, tokens
from corpusloom.operators import hashed
from corpusloom.operators.graph import components

# Lines that repetition never removes, and what a page number looks like.
KEPT_LINE = r"^(#{1,6}\s|>\s|[-*+]\s|\d+[.)]\s|\||```)"
PAGE_NUMBER = r"^\s*[-—–\[\(（]*\s*(?:第\s*)?\d{1,4}\s*(?:页|/\s*\d{1,4})?\s*[-—–\]\)）]*\s*$"
SENTENCE_TAIL = "。！？；：!?;:.”』」）)]】》-—–"


def without_invisible(text: Column) -> Column:
    """Drops control, zero-width, direction and private-use characters; joins hyphenated line ends; LF only; tabs as four spaces."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]", "")
    text = F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")
    return F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\t"), F.lit("    "))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, line, fenced (inside a code fence or one of its marks)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    mark = F.when(F.trim("line").startswith("```"), 1).otherwise(0)
    before = F.sum(mark).over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("fenced", (before % 2 == 1) | (mark == 1))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 40, times: int = 3) -> DataFrame:
    """doc_id, line, n: short lines that occur `times` times or more in a document outside headings, lists, tables and fences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(text_col, "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    rows = rows.filter((F.length("line") > 0) & (F.length("line") <= most) & ~F.col("line").rlike(KEPT_LINE))
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER) & (F.length(line) <= 12) & (line != "")


def page_numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, line: the lines outside fences that are page numbers."""
    rows = lines_of(docs, id_col, text_col).filter(~F.col("fenced")).select("doc_id", "pos", F.trim("line").alias("line"))
    return rows.filter(is_page_number(F.col("line")))


def cleaned_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lines_of with dropped: repeated short lines and page numbers outside fences."""
    rows = lines_of(docs, id_col, text_col)
    line = F.trim("line")
    times = F.count(F.when((F.length(line) > 0) & (F.length(line) <= 40) & ~line.rlike(KEPT_LINE), 1)).over(Window.partitionBy("doc_id", line))
    return rows.withColumn("dropped", ~F.col("fenced") & ((times >= 3) | is_page_number(line)))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """doc_id, simhash, n_chars: bit i is set when more tokens have it set in the first 8 bytes of their MD5 than not.

    A text without tokens has 0; with `characters`, its lower-cased characters are its tokens, and only empty texts have 0.
    Rows that repeat an id are one text's. All others are hashed row by row, without a shuffle; a null id has 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    if again.isEmpty():
        return _simhash_by_row(rows, characters)
    return _simhash_by_row(rows.join(again, "doc_id", "left_anti"), characters).union(_simhash_by_id(rows.join(again, "doc_id", "left_semi"), characters))


def _simhash_by_row(rows: DataFrame, characters: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, low in hashed.texts(batches):
            made = np.where(own.column("doc_id").is_valid(), hashed.simhashes(low, characters), 0)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_chars"), pa.array(made)], ["doc_id", "n_chars", "simhash"])

    rows = rows.select("doc_id", F.length("text").alias("n_chars"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars int, simhash long")


def _simhash_by_id(docs: DataFrame, characters: bool) -> DataFrame:
    found = tokens(F.col("text"))
    if characters:
        low = F.lower(F.coalesce(F.col("text"), F.lit("")))
        found = F.when((F.size(found) > 0) | (low == ""), found).otherwise(F.split(low, ""))
    terms = docs.select("doc_id", F.explode(found).alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("tf"))
    terms = terms.withColumn("h", hex_to_long(F.substring(F.md5("t"), 1, 16)))
    votes = [F.sum(F.when(F.getbit("h", F.lit(i)) == 1, F.col("tf")).otherwise(-F.col("tf"))).alias(f"b{i}") for i in range(64)]
    bit = lambda i: F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    value = bit(0)
    for i in range(1, 64):
        value = value.bitwiseOR(bit(i))
    found = terms.groupBy("doc_id").agg(*votes).select("doc_id", value.alias("simhash"))
    return docs.select("doc_id", F.length("text").alias("n_chars")).join(found, "doc_id", "left").na.fill({"simhash": 0})


def simhash_bands(hashes: DataFrame, bands: int = 4) -> DataFrame:
    """doc_id, band, value: the hash in `bands` slices, from its lowest bits."""
    width = 64 // bands
    value = lambda i: F.shiftrightunsigned("simhash", i * width).bitwiseAND(F.lit((1 << width) - 1))
    return hashes.select("doc_id", F.posexplode(F.array(*[value(i) for i in range(bands)])).alias("band", "value"))


def pair_masks(distance: int) -> list[int]:
    """Every two of distance + 2 slices of 64 bits as a signed mask: `distance` different bits leave at least two slices equal."""
    edges = [64 * i // (distance + 2) for i in range(distance + 3)]
    slices = [(1 << hi) - (1 << lo) for lo, hi in pairwise(edges)]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(slices, 2))]


def near_classes(hashes: DataFrame, distance: int = 3, tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """The classes of equal (simhash, n_chars) with their smallest id as doc_id; and a, b (a < b), distance of near classes.

    Candidates agree in two of distance + 2 slices, 25 bits for a distance of 3, and in a range of lengths, of which one
    side takes every range that `tolerance` (below 1) reaches. A class of length 0 is compared at any length.
    """
    groups = hashes.groupBy("simhash", "n_chars").agg(F.min("doc_id").alias("doc_id"))
    bands = groups.select("*", F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in pair_masks(distance)])).alias("band", "value"))
    near, width = -math.log(1 - tolerance) + 1e-9, max(-8 * math.log(1 - tolerance), 0.01)
    size = lambda shift: F.floor((F.ln("n_chars") + shift) / width)
    sized, empty = bands.filter("n_chars > 0"), bands.filter("n_chars = 0")
    here = sized.withColumn("size", size(0.0))
    around = sized.withColumn("size", F.explode(F.sequence(size(-near), size(near))))
    apart = "bit_count(x.simhash ^ y.simhash)"
    close = f"x.band = y.band AND x.value = y.value AND {apart} <= {distance}"
    pair = [F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"), F.expr(apart).alias("distance")]
    long = f"x.size = y.size AND x.doc_id < y.doc_id AND abs(x.n_chars - y.n_chars) <= {tolerance} * greatest(x.n_chars, y.n_chars)"
    pairs = around.alias("x").join(here.alias("y"), F.expr(f"{close} AND {long}")).select(pair)
    odd = empty.alias("x").join(bands.alias("y"), F.expr(f"{close} AND x.doc_id <> y.doc_id")).select(pair)
    return groups, pairs.union(odd).distinct()


def near_pairs(hashes: DataFrame, distance: int = 3, tolerance: float = 0.02) -> DataFrame:
    """a, b (a < b), distance: pairs of documents within `distance` bits and `tolerance` in length.

    Equal hashes are merged first, so that copies don't fill a band; `near_classes` loses no pair.
    Documents with equal hashes are paired with the smallest of them.
    """
    groups, pairs = near_classes(hashes, distance, tolerance)
    same = hashes.join(groups.withColumnRenamed("doc_id", "a"), ["simhash", "n_chars"]).filter("doc_id > a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("distance"))
    return pairs.union(same)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder of spark.checkpoint.dir; only a local master gets a temporary one where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not top and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


#: Rounds over all open documents before components are settled by themselves, and pairs of a component that one task settles.
ROUNDS, SETTLED_PAIRS = 4, 500_000


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Decides the documents of a component in id order. rows: pairs a, b of open documents, and whether a kept one drops either."""
    before: dict[int, list[int]] = {}
    hit: dict[int, bool] = {}
    for a, b, a_hit, b_hit in rows[["a", "b", "a_hit", "b_hit"]].itertuples(index=False):
        before.setdefault(b, []).append(a)
        hit[a], hit[b] = a_hit, b_hit
    kept: dict[int, bool] = {}
    for doc in sorted(hit):
        kept[doc] = not hit[doc] and not any(kept[x] for x in before.get(doc, ()))
    return pd.DataFrame({"doc_id": list(kept), "kept": list(kept.values())})


def _settled(state: DataFrame, pairs: DataFrame, told: DataFrame, most: int) -> DataFrame:
    """doc_id, kept of the open documents whose component among the open ones has at most `most` pairs."""
    open_ = cut(state.filter("kept IS NULL").select("doc_id").join(told.select("doc_id", "hit"), "doc_id").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit")))
    end = lambda c: open_.select(F.col("doc_id").alias(c), F.col("hit").alias(f"{c}_hit"))
    inside = cut(pairs.join(end("a"), "a").join(end("b"), "b"))
    sized = inside.join(components(inside, cut).withColumnRenamed("node", "a"), "a")
    few = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("component")
    done = sized.join(few, "component", "left_semi").groupBy("component").applyInPandas(_settle, "doc_id long, kept boolean")
    ends = inside.select(F.col("a").alias("doc_id")).union(inside.select("b"))
    return done.union(open_.join(ends, "doc_id", "left_anti").select("doc_id", (~F.col("hit")).alias("kept")))


def greedy_keep(nodes: DataFrame, pairs: DataFrame, rounds: int = ROUNDS, settled_pairs: int = SETTLED_PAIRS) -> DataFrame:
    """doc_id, kept: in id order, a document is dropped if a kept earlier one is its pair (a < b); a dropped one drops no other.

    Only documents in pairs have a state. A round decides those whose earlier partners are all decided. What is open
    after `rounds` of them, such as long chains of versions, is cut into components, and one task each settles those of
    at most `settled_pairs` pairs; larger ones go on in rounds.
    """
    pairs = cut(pairs.select("a", "b"))
    later = pairs.select(F.col("b").alias("doc_id")).distinct().withColumn("open", F.lit(True))
    state = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct().join(later, "doc_id", "left")
    state = cut(state.select("doc_id", F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("kept")))
    before, turn = None, 0
    while left := state.filter("kept IS NULL").count():
        if left == before:
            raise RuntimeError(f"{left} documents wait for one another: pairs need a < b")
        before, turn = left, turn + 1
        told = pairs.join(state.select(F.col("doc_id").alias("a"), F.col("kept").alias("a_kept")), "a").groupBy(F.col("b").alias("doc_id"))
        told = told.agg(F.bool_or("a_kept").alias("hit"), F.bool_or(F.col("a_kept").isNull()).alias("wait"))
        if turn == rounds + 1:
            done = cut(_settled(state, pairs, told, settled_pairs)).withColumnRenamed("kept", "now")
            state = cut(state.join(done, "doc_id", "left").select("doc_id", F.coalesce("kept", "now").alias("kept")))
            before = None  # it may have been nothing that was small enough
            continue
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.col("wait"), F.lit(None)).otherwise(True)
        state = cut(state.join(told, "doc_id", "left").select("doc_id", decided.alias("kept")))
    return nodes.select("doc_id").join(state, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(True)).alias("kept"))


def greedy_dedup(hashes: DataFrame, distance: int = 3, tolerance: float = 0.02) -> DataFrame:
    """doc_id, kept: greedy_keep over all pairs within `distance` and `tolerance`, decided per class of equal (simhash, n_chars).

    A class's later members are near its first one and near all that this is near, so they are dropped either way. A null
    text is near nothing and stays.
    """
    hashes = cut(hashes.select("doc_id", "simhash", "n_chars"))  # they are read for the classes, by every side of the pairs, and at the end
    groups, pairs = near_classes(hashes, distance, tolerance)
    firsts = greedy_keep(groups.filter("n_chars IS NOT NULL"), pairs)
    classes = groups.join(firsts, "doc_id").select("simhash", "n_chars", F.col("doc_id").alias("first"), F.col("kept").alias("first_kept"))
    kept = F.when(F.col("first").isNull(), True).otherwise((F.col("doc_id") == F.col("first")) & F.col("first_kept"))
    return hashes.join(classes, ["simhash", "n_chars"], "left").select("doc_id", kept.alias("kept"))


_SENTENCE = re.compile("[^。！？!?…；;\n]*(?:[。！？!?…；;\n][”’」』）)\\]\"']*|$)")


def sentence_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ordinal, start, n_chars, content of the sentences of every text: text[start : start + n_chars] is the content.

    A null id's rows count as one text.
    """
    pieces = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SENTENCE), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("pos", "piece"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    head = F.length(F.regexp_extract("piece", r"^\s*", 0))
    rows = rows.select("doc_id", "pos", (F.sum(F.length("piece")).over(order) - F.length("piece") + head).alias("start"), F.regexp_replace("piece", r"^\s+|\s+$", "").alias("content"))
    rows = rows.filter("content <> ''")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("ordinal"), "start", F.length("content").alias("n_chars"), "content")


def packed_chunks(docs: DataFrame, size: int = 600, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ordinal, start, content, n_chars: sentences packed in order while a chunk's span stays within `size` characters.

    A longer sentence is a chunk of its own, and text[start : start + n_chars] is the content.
    """

    def spans(text: str) -> Iterator[tuple[int, int]]:
        begin = end = -1
        for m in _SENTENCE.finditer(text):
            body = m[0].strip()
            if not body:
                continue
            a = m.start() + m[0].index(body)
            b = a + len(body)
            if begin >= 0 and b - begin > size:
                yield begin, end
                begin = -1
            begin, end = (a if begin < 0 else begin), b
        if begin >= 0:
            yield begin, end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, n, a, t[a:b], b - a) for i, t in zip(rows["doc_id"], rows["text"], strict=True) if t for n, (a, b) in enumerate(spans(t))]
            yield pd.DataFrame(out, columns=["doc_id", "ordinal", "start", "content", "n_chars"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ordinal int, start int, content string, n_chars int")


def chunk_window(chunks: DataFrame, hits: DataFrame, span: int = 2) -> DataFrame:
    """hit_doc, hit_ordinal and the chunks at most `span` places away in the same document: an equi-join on exploded places."""
    near = hits.select("doc_id", F.col("ordinal").alias("hit_ordinal"), F.explode(F.sequence(F.col("ordinal") - span, F.col("ordinal") + span)).alias("ordinal"))
    return near.join(chunks, ["doc_id", "ordinal"])


def read_prefix(chunks: DataFrame, limit: int = 12_000) -> DataFrame:
    """A document's chunks by place until their characters would exceed `limit`; the first always."""
    total = F.sum("n_chars").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return chunks.withColumn("total", total).filter((F.col("total") <= limit) | (F.col("ordinal") == 0))
