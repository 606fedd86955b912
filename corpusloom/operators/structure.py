"""Whole cleaning of texts, and chunks that follow their structure, as windows over lines, units and atoms."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusloom.functions.text import SENTENCE
from corpusloom.operators.corpus import KEPT_LINE, SENTENCE_TAIL, cleaned_lines, without_invisible

# Punctuation whose long runs become one, and what headings and list items look like.
PUNCTUATION_RUN = r"([，。！？；：、,.!?;:])\1{3,}"
BLANK_RUN = "[ \\t\u00a0\u3000]{2,}"
MD_HEADING = r"^(#{1,6})\s+(.*)$"
CN_HEADING = r"^(第\s*[一二三四五六七八九十百零〇\d]+\s*[章节篇部分])\s*[、.:：]?\s*(.{0,60})$"
NUMBER_HEADING = r"^(\d+(?:\.\d+){0,3})[、.\s]{1,2}(\S.{0,40})$"
LIST_ITEM = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"
LEVELS = 6


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", "")


def clean_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, cleaned, original_chars, cleaned_chars, dropped_lines, merged_lines, removed_ratio of every text.

    In this order: NFKC; invisible characters, hyphens at line ends, line ends, tabs; repeated short lines and page
    numbers; wrapped lines; runs of punctuation, blanks and empty lines; blanks around lines. A line joins the one before
    it, without a separator, if that is 12 characters or more, joined lines included, and doesn't end a sentence, and
    neither is a table row nor this one a heading, quote or list item; whether it joins follows from its run of lines
    that may join, so no line waits for another. Null and repeated ids are rows of their own. Null counts as empty.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    # A row's lines are known by its place, and carry what its result needs, so that nothing is joined by id.
    row = F.struct(F.monotonically_increasing_id().alias("at"), "id", F.length("raw").alias("original_chars"))
    rows = raw.select(row.alias("doc_id"), F.regexp_replace(without_invisible(nfkc("raw")), r"(?m)[ \t\f\x0B\u00a0\u3000]+$", "").alias("t"))
    lines = cleaned_lines(rows, "doc_id", "t").select("doc_id", "pos", "fenced", "dropped", stripped(F.col("line")).alias("line"))
    # Dropped lines are as good as not there: windows are over the others.
    doc = Window.partitionBy("doc_id", "dropped").orderBy("pos")
    before, line = F.lag("line").over(doc), F.col("line")
    open_ = ~F.lit(SENTENCE_TAIL).contains(F.substring(before, -1, 1)) & ~line.rlike(KEPT_LINE) & ~line.startswith("#")
    may = (F.coalesce(before, F.lit("")) != "") & (line != "") & open_ & ~F.col("fenced")
    kept = lines.withColumn("may", F.coalesce(may, F.lit(False))).withColumn("long", (F.length("line") >= 12) & ~line.startswith("|"))
    kept = kept.withColumn("run", F.sum((~F.col("may")).cast("int")).over(doc))
    run = Window.partitionBy("doc_id", "dropped", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("joins", F.col("may") & F.coalesce(F.max("long").over(run), F.lit(False)))
    piece = F.when(~F.col("dropped"), F.struct("pos", F.concat(F.when(F.col("joins"), "").otherwise("\n"), "line").alias("p")))
    whole = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).alias("ps"), F.count_if(F.col("joins") & ~F.col("dropped")).alias("merged_lines"), F.count_if("dropped").alias("dropped_lines"))
    text = F.array_join(F.transform("ps", lambda x: x["p"]), "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, PUNCTUATION_RUN, "$1"), BLANK_RUN, " "), "\n{3,}", "\n\n")
    text = F.regexp_replace(stripped(F.regexp_replace(text, r"(?m)^[ \u00a0\u3000]+|[ \u00a0\u3000]+$", "")), "\n{3,}", "\n\n")
    out = whole.select(F.col("doc_id.id").alias("doc_id"), text.alias("cleaned"), F.col("doc_id.original_chars").alias("original_chars"), "dropped_lines", "merged_lines")
    n = F.length("cleaned")
    ratio = F.when(F.col("original_chars") == 0, 0.0).otherwise(F.round(1 - n / F.col("original_chars"), 4))
    return out.select("doc_id", "cleaned", "original_chars", n.alias("cleaned_chars"), "dropped_lines", "merged_lines", ratio.alias("removed_ratio"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit, kind, start, stop, heading: the blocks of each text between blank lines, by their kind.

    Code runs from a fence to the next one; table rows are lines that begin with |; a list goes on through items and
    indented lines; a Markdown heading is a line of its own anywhere, a numbered or chapter heading only where no
    paragraph runs; all else is prose. heading is the path of the headings in force, the unit's own included.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    all_before = doc.rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(all_before), F.lit(0))
    rows = rows.select("doc_id", "pos", "line", start.alias("start"), stripped(F.col("line")).alias("s"), F.length("line").alias("n"))
    fence = F.col("s").startswith("```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(doc)).withColumn("fence", fence)
    code = F.col("fence") | (F.col("fences") % 2 == 1)
    shape = (
        F.when(code, "code").when(F.col("s") == "", "blank").when(F.col("s").startswith("|"), "table").when(F.col("s").rlike(MD_HEADING), "heading")
        .when(F.col("line").rlike(LIST_ITEM), "list").when(F.col("line").rlike("^[ \t]"), "indented").otherwise("plain")
    )
    rows = rows.withColumn("shape", shape)
    # An indented line belongs to the list that the last line of another shape is in.
    last = F.last(F.when(F.col("shape") != "indented", F.col("shape")), True).over(doc)
    rows = rows.withColumn("kind", F.when(F.col("shape") == "indented", F.when(last == "list", "list").otherwise("plain")).otherwise(F.col("shape")))
    short = F.length("s") <= 60
    chapter = F.col("s").rlike(CN_HEADING) & short
    number = F.col("s").rlike(NUMBER_HEADING) & short & ~F.col("s").endswith("。")
    changed = F.coalesce(F.lag("kind").over(doc) != F.col("kind"), F.lit(True)).cast("int")
    rows = rows.withColumn("named", (F.col("kind") == "plain") & (chapter | number)).withColumn("chapter", chapter).withColumn("run", F.sum(changed).over(doc))
    # Of a run of plain lines, those before the first that is no heading are headings.
    lead = F.min("named").over(Window.partitionBy("doc_id", "run").orderBy("pos"))
    rows = rows.withColumn("kind", F.when(F.col("kind") == "plain", F.when(lead, "heading").otherwise("prose")).otherwise(F.col("kind")))
    same = (F.lag("kind").over(doc) == F.col("kind")) & (F.col("kind") != "heading")
    same = same & ((F.col("kind") != "code") | ~F.col("fence") | (F.col("fences") % 2 == 0))
    rows = rows.withColumn("unit", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(doc)).filter("kind <> 'blank'")
    hashes, numbers = F.length(F.regexp_extract("s", MD_HEADING, 1)), F.regexp_extract("s", NUMBER_HEADING, 1)
    level = F.when(hashes > 0, hashes).when(F.col("chapter"), 2).otherwise(F.least(F.lit(LEVELS), F.length(numbers) - F.length(F.replace(numbers, F.lit("."), F.lit(""))) + 2))
    title = F.when(hashes > 0, stripped(F.regexp_extract("s", MD_HEADING, 2))).when(F.col("chapter"), stripped(F.concat_ws(" ", F.regexp_extract("s", CN_HEADING, 1), F.regexp_extract("s", CN_HEADING, 2)))).otherwise(F.col("s"))
    rows = rows.withColumn("level", F.when(F.col("kind") == "heading", level))
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("pos", title.alias("title"))), True).over(doc))
        rows = rows.withColumn(f"b{k}", F.last(F.when(F.col("level") < k, F.col("pos")), True).over(doc))
    path = F.concat_ws(" > ", *[F.when(F.col(f"h{k}.pos") > F.coalesce(F.col(f"b{k}"), F.lit(-1)), F.col(f"h{k}.title")) for k in range(1, LEVELS + 1)])
    rows = rows.select("doc_id", "unit", "kind", "start", (F.col("start") + F.col("n")).alias("stop"), path.alias("path"))
    whole = rows.groupBy("doc_id", "unit").agg(F.first("kind").alias("kind"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("path", "start").alias("heading"))
    return whole


@F.pandas_udf(ArrayType(IntegerType()))
def packed(starts: pd.Series, stops: pd.Series, breaks: pd.Series, limit: pd.Series) -> pd.Series:
    """The group of each range: a group goes on while its span stays within the limit and no break comes."""

    def one(a: np.ndarray, b: np.ndarray, cut: np.ndarray, most: int) -> np.ndarray:
        group = np.zeros(len(a), np.int32)
        first = 0
        fresh = np.append(np.flatnonzero(cut), len(a))
        while first < len(a):
            to = min(int(np.searchsorted(b, a[first] + most, side="right")), int(fresh[np.searchsorted(fresh, first, side="right")]))
            to = max(to, first + 1)
            group[to:] += 1
            first = to
        return group

    return pd.Series([one(*x) for x in zip(starts, stops, breaks, limit, strict=True)])


def _grouped(rows: DataFrame, keys: list[str], limit: int, out: str) -> DataFrame:
    """rows (start, stop, cut) with the number of their group, packed in order of start within keys."""
    rest = [c for c in rows.columns if c not in keys]
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop", *[c for c in rest if c not in ("start", "stop")]))).alias("r"))
    column = lambda name: F.transform("r", lambda x: x[name])
    lists = lists.withColumn("g", packed(column("start"), column("stop"), column("cut"), F.lit(limit)))
    return lists.select(*keys, F.explode(F.arrays_zip("r", "g")).alias("x")).select(*keys, "x.r.*", F.col("x.g").alias(out))


@F.pandas_udf(ArrayType(IntegerType()))
def _last_at_most(bounds: pd.Series, values: pd.Series) -> pd.Series:
    """Of each value the greatest bound that isn't above it, or the value -1."""
    return pd.Series([np.append(-1, np.sort(b))[np.searchsorted(np.sort(b), v, side="right")].astype(np.int32) for b, v in zip(bounds, values, strict=True)])


def split_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 600, overlap: int = 80, least: int = 40, most: int = 1600) -> DataFrame:
    """doc_id, ordinal, start, n_chars, heading, kind, content: chunks of about `size` characters that follow a text's structure.

    Units over `most` characters are cut into atoms, code and tables at lines, others at sentences, packed up to `size`.
    Atoms under the same heading are packed up to `size`; code and tables stay alone. A group under `least` characters
    joins the one before it under the same heading, if that isn't code or a table. A chunk starts at the last border of an
    atom at least `overlap` characters before the end of the one before it. Every content is the text from `start` on.
    Null and blank texts have no chunks. Ids must not repeat.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = units(text)
    big = F.col("stop") - F.col("start") > most
    cells = found.filter(big).join(text, "doc_id").withColumn("body", F.expr("substring(text, start + 1, stop - start)"))
    by_line = F.regexp_extract_all("body", F.lit("[^\n]*(?:\n|$)"), F.lit(0))
    by_sentence = F.regexp_extract_all("body", F.lit(SENTENCE), F.lit(0))
    cells = cells.select("doc_id", "unit", "kind", "heading", F.col("start").alias("base"), F.posexplode(F.when(F.col("kind").isin("code", "table"), by_line).otherwise(by_sentence)).alias("i", "p"))
    inside = Window.partitionBy("doc_id", "unit").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("at", F.col("base") + F.coalesce(F.sum(F.length("p")).over(inside), F.lit(0)))
    body = F.when(F.col("kind").isin("code", "table"), F.regexp_replace("p", "\n$", "")).otherwise(stripped(F.col("p")))
    begin = F.when(F.col("kind").isin("code", "table"), F.lit(0)).otherwise(F.length("p") - F.length(F.regexp_replace("p", r"^[\s\u00a0\u3000]+", "")))
    cells = cells.withColumn("body", body).filter(F.length("body") > 0).select(
        "doc_id", "unit", (F.col("at") + begin).alias("start"), (F.col("at") + begin + F.length("body")).alias("stop"), F.lit(False).alias("cut"), "kind", "heading"
    )
    atoms = _grouped(cells, ["doc_id", "unit"], size, "g").groupBy("doc_id", "unit", "g").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("kind").alias("kind"), F.first("heading").alias("heading")
    )
    atoms = found.filter(~big).select("doc_id", "start", "stop", "kind", "heading").union(atoms.select("doc_id", "start", "stop", "kind", "heading"))
    doc = Window.partitionBy("doc_id").orderBy("start")
    alone = F.col("kind").isin("code", "table") & (F.col("stop") - F.col("start") <= most)
    atoms = atoms.withColumn("alone", alone)
    cut = F.col("alone") | F.coalesce(F.lag("alone").over(doc), F.lit(True)) | (F.lag("heading").over(doc) != F.col("heading"))
    atoms = atoms.withColumn("cut", cut)
    groups = _grouped(atoms.drop("alone"), ["doc_id"], size, "g").groupBy("doc_id", "g").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", "start").alias("kind"), F.min_by("heading", "start").alias("heading")
    )
    small = (F.col("stop") - F.col("start") < least) & (F.lag("heading").over(doc) == F.col("heading"))
    groups = groups.withColumn("small", F.coalesce(small, F.lit(False))).withColumn("run", F.sum((~F.col("small")).cast("int")).over(doc))
    earlier = Window.partitionBy("doc_id", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    joins = F.col("small") & F.coalesce(F.bool_or(~F.col("kind").isin("code", "table")).over(earlier), F.lit(False))
    groups = groups.withColumn("joins", joins).withColumn("m", F.sum((~F.col("joins")).cast("int")).over(doc))
    merged = groups.groupBy("doc_id", "m").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", "start").alias("kind"), F.min_by("heading", "start").alias("heading"))
    # An overlap's start never goes back behind that of the chunk before, which is itself such a border.
    bounds = atoms.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "stop"))).alias("bounds"))
    lists = merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "heading"))).alias("r")).join(bounds, "doc_id")
    lists = lists.withColumn("back", _last_at_most("bounds", F.transform("r", lambda x: x["stop"] - overlap)))
    moved = F.transform("r", lambda x, i: F.struct(
        F.when((i == 0) | F.lit(overlap <= 0), x["start"]).otherwise(F.least(x["start"], F.greatest(F.col("r")[0]["start"], F.get("back", i - 1).cast("long")))).alias("start"),
        x["stop"].alias("stop"), x["kind"].alias("kind"), x["heading"].alias("heading")))
    rows = lists.select("doc_id", F.explode(moved).alias("x")).select("doc_id", "x.*").join(text, "doc_id")
    rows = rows.withColumn("raw", F.expr("substring(text, start + 1, stop - start)")).withColumn("content", stripped(F.col("raw"))).filter("content <> ''")
    skip = F.length("raw") - F.length(F.regexp_replace("raw", r"^[\s\u00a0\u3000]+", ""))
    rows = rows.select("doc_id", (F.col("start") + skip).cast("int").alias("start"), F.length("content").alias("n_chars"), F.nullif("heading", F.lit("")).alias("heading"), "kind", "content", "stop")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("stop")) - 1).select("doc_id", "ordinal", "start", "n_chars", "heading", "kind", "content")
