"""Repeated passages across documents: content-defined paragraphs, MinHash banding, exact Jaccard and components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_among, steps, stored, table
from .graph import components
from .textops import mix, sliding_min, utf8, words

SHINGLE = 5
PERCENT = 80
#: Words of a paragraph, and of neighbouring places of which one at least starts a paragraph. Two texts that share
#: PARAGRAPH + REACH - 1 = 50 words in a row thus share a whole paragraph, wherever the passage and its lines begin.
PARAGRAPH, REACH = 20, 31
#: Bands x rows: two paragraphs of similarity 0.8 share a band with probability 1 - (1 - 0.8^2)^3 = 0.953. Different
#: paragraphs without repeated shingles share at least 15 of 17 shingles if they link, which makes it 0.989.
BANDS, ROWS = 3, 2
#: Bits of the map of shared keys, in words of 64; it only spares shuffling the others.
MAP_WORDS = 1 << 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Paragraphs:
    text: np.ndarray  #: number of the text
    word: np.ndarray  #: number of the first word in the text
    start: np.ndarray  #: first character in the text
    stop: np.ndarray  #: character after the last
    node: np.ndarray  #: hash of all words
    first: np.ndarray  #: number of the first shingle in `shingles`
    shingles: np.ndarray  #: hashes of the five-word shingles that start at each word of all texts


def paragraphs(texts: pa.Array) -> Paragraphs:
    """The paragraphs of all texts: PARAGRAPH lower-cased words from each chosen word on, whatever white space parts them.

    Of every REACH neighbouring words that can start a paragraph, the one is chosen whose three-word hash is least, of
    equal ones the first. The choice depends on these words only, so that equal passages are cut alike. A text with fewer
    such words, but one at least, has one paragraph; a text of fewer than PARAGRAPH words has none.
    """
    w = words(texts, lower=True)
    own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w.distinct.to_pylist()), np.uint64, len(w.distinct))
    h = own[w.codes] if len(own) else np.zeros(0, np.uint64)
    ends = w.ends.astype(np.int64)
    places = w.per_text - PARAGRAPH + 1
    fit = places > 0
    none = np.zeros(0, np.int64)
    if not fit.any():
        return Paragraphs(none, none, none, none, none, none, np.zeros(0, np.uint64))
    with np.errstate(over="ignore"):
        grams = mix(h[:-2] * _A + h[1:-1] * _B + h[2:] * _C)
        shingles = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            shingles = mix(shingles + h[i : len(h) - SHINGLE + 1 + i] * np.uint64(0x9E3779B97F4A7C15 + 2 * i))
    begins = (ends - w.per_text)[fit]
    places = places[fit]
    low = np.uint64(0xFFFFFF)
    order = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    usable = np.zeros(len(h) + 1, np.int8)
    usable[begins] += 1
    usable[begins + places] -= 1
    order[np.cumsum(usable)[: len(order)] == 0] = ~np.uint64(0)
    order = np.concatenate((order, np.full(REACH, ~np.uint64(0))))
    least = sliding_min(order, REACH)
    turns = np.maximum(places - REACH, 0) + 1
    at = np.repeat(begins - (np.cumsum(turns) - turns), turns) + np.arange(int(turns.sum()))
    chosen = at + ((least[at] - at.astype(np.uint64)) & low).astype(np.int64)
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    with np.errstate(over="ignore"):
        node = np.zeros(len(chosen), np.uint64)
        for i in range(PARAGRAPH):
            node = mix(node * _B + h[chosen + i])
    raw, bounds = utf8(texts)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    text = np.searchsorted(ends, chosen, side="right")
    base = chars[bounds[text]]
    return Paragraphs(text, chosen - (ends - w.per_text)[text], chars[w.starts[chosen]] - base, chars[w.stops[chosen + PARAGRAPH - 1]] - base, node.view(np.int64), chosen, shingles)


def band_keys(p: Paragraphs) -> np.ndarray:
    """paragraphs x BANDS: a hash of ROWS minima over the paragraph's shingles each."""
    out = np.zeros((len(p.first), BANDS), np.uint64)
    if len(p.first):
        n = PARAGRAPH - SHINGLE + 1
        padded = np.append(p.shingles, ~np.uint64(0))
        edges = np.stack((p.first, p.first + n), 1).ravel()
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                key = np.full(len(p.first), b + 1, np.uint64)
                for r in range(ROWS):
                    f = (padded ^ np.uint64(0xA24BAED4963EE407 * (b * ROWS + r + 1) % 2**64)) * np.uint64(0x9FB21C651E98DF25)
                    f ^= f >> np.uint64(29)
                    key = mix(key * np.uint64(31) + np.minimum.reduceat(f, edges)[0::2])
                out[:, b] = key
    return out.view(np.int64)


def lead_of(p: Paragraphs, keys: np.ndarray) -> np.ndarray:
    """paragraphs x BANDS: the number of the first paragraph of a chain that shares the key, each overlapping the one before.

    Paragraphs that overlap share shingles and so often a band; this tells such a key from one that two places share.
    """
    lead = np.tile(np.arange(len(keys))[:, None], (1, keys.shape[1]))
    for step in range(1, PARAGRAPH):
        a, b = np.arange(len(keys) - step), np.arange(step, len(keys))
        near = (p.text[a] == p.text[b]) & (p.word[b] < p.word[a] + PARAGRAPH)
        if not near.any():
            break
        for k in range(keys.shape[1]):
            same = near & (keys[a, k] == keys[b, k])
            lead[b[same], k] = np.minimum(lead[b[same], k], lead[a[same], k])
    return lead


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        p = paragraphs(batch.column(1))
        keys = band_keys(p)
        # A place is PARAGRAPH words of a chain of overlapping paragraphs with this key; 31 bits tell it from most others.
        with np.errstate(over="ignore"):
            ids = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            lead = lead_of(p, keys)
            own = mix(ids[p.text] + _A) + p.word.astype(np.uint64) * _B
            places = (mix(own[lead] + ((p.word[:, None] - p.word[lead]) // PARAGRAPH).astype(np.uint64) * _C) >> np.uint64(33)).astype(np.int32)
        ints = [pa.array(x, pa.int32()) for x in (p.word, p.start, p.stop)]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(p.node) + 1) * BANDS, BANDS), pa.int32()), pa.array(x.ravel())) for x in (keys, places)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(p.text)), *ints, pa.array(p.node), *lists], ["doc_id", "word", "start", "stop", "node", "keys", "places"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, wanted nodes -> node, its place, its distinct shingles."""
    for batch in steps(batches):
        p = paragraphs(batch.column(1))
        lists = batch.column(2)
        wanted = np.asarray(lists.flatten())
        owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        asked = set(zip(owner.tolist(), wanted.tolist(), strict=True))
        take = []
        for i, pair in enumerate(zip(p.text.tolist(), p.node.tolist(), strict=True)):
            if pair in asked:
                asked.discard(pair)
                take.append(i)
        sets = [np.unique(p.shingles[a : a + PARAGRAPH - SHINGLE + 1]).view(np.int64) for a in p.first[take].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.node[take]), batch.column(0).take(pa.array(p.text[take])), pa.array(p.word[take], pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
            ["node", "doc_id", "word", "tokens"],
        )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with a Jaccard similarity of percent / 100, by whole sets; overlapping places of one text are no pair."""
    x = sets.select(F.col("node").alias("a"), F.col("doc_id").alias("x_doc"), F.col("word").alias("x_word"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("doc_id").alias("y_doc"), F.col("word").alias("y_word"), F.col("tokens").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    apart = (F.col("x_doc") != F.col("y_doc")) | (F.abs(F.col("x_word") - F.col("y_word")) >= PARAGRAPH)
    return pairs.join(x, "a").join(y, "b").filter(apart & (100 * same >= percent * (F.size("x") + F.size("y") - same))).select("a", "b")


def _rarest(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, token: the prefix of each set in order of frequency among these sets; sets that link share one of its tokens."""
    tokens = sets.join(nodes, "node", "left_semi").select("node", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    ranked = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("t"))
    short = F.size("t") - F.ceil(F.size("t") * percent / 100).cast("int") + 1
    return ranked.select("node", F.explode(F.slice("t", 1, short)).alias("t")).select("node", "t.token")


def classes(parts: DataFrame, live: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """node, component of the different paragraphs that are linked; live: key, node of the keys that several places share.

    Paragraphs that share a band are candidates. Each is first tried against the smallest one of its bands, and what
    links is contracted, which settles groups in which most link. Under each key that still holds different components,
    only those are paired that also share one of the rarest shingles of each, which all that link do: paragraphs that
    were edited in different places share a band, but not their rare shingles.
    """
    shared = live.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key", "lo")
    live = stored(live.join(shared, "key"))
    active = live.select("node").distinct()
    where = maybe_among(parts.select("doc_id", "node"), "node", active, MAP_WORDS).join(active, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = stored(where.groupBy("doc_id").agg(F.collect_list("node").alias("wanted")))
    found = maybe_among(texts, "doc_id", wanted).join(wanted, "doc_id").select("doc_id", "text", "wanted")
    sets = stored(found.mapInArrow(_sets, "node long, doc_id long, word int, tokens array<long>").dropDuplicates(["node"]))
    stars = live.groupBy("node").agg(F.min("lo").alias("lo")).filter("lo <> node").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    links = stored(_linked(stars, sets, percent))
    now = live.select("key", "node").join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    left = stored(now.join(mixed, "key"))
    left = stored(left.join(_rarest(left.select("node").distinct(), sets, percent), "node"))
    pairs = left.alias("x").join(left.alias("y"), F.expr("x.key = y.key AND x.token = y.token AND x.node < y.node AND x.comp <> y.comp"))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return components(links.union(stored(_linked(pairs, sets, percent))))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per repeated passage: doc_id, start, length, n_words, removed, keep_doc_id, components.

    Texts are cut into content-defined paragraphs of PARAGRAPH words (see `paragraphs`), so that a passage of 50 words or
    more is found wherever it stands and however its lines are broken. Paragraphs with the same lower-cased words are one
    node. Nodes with a MinHash band in common are candidates; two link if the Jaccard similarity of their sets of
    five-word shingles, computed exactly, is at least `percent` / 100. Of every component the first paragraph, by doc_id
    and then place, stays; all others are removed, also repeats within a document, unless they overlap the one that
    stays. Paragraphs of a document that start at most REACH words apart, as neighbours do, and are all removed or all
    stay, make one passage with the words between them; start and length are in characters. keep_doc_id is the smallest document in which a paragraph of the passage stays,
    components are those of its paragraphs. Rows with removed = false show the passages that stay.

    Nodes are told apart by 64 bits of hash. Null, empty and shorter texts have no paragraphs. Rows with a null id are
    left out, as nothing could refer to them. Rows that repeat an id are texts of their own, copies of one another if
    equal; passages under one id are merged only where they are in one place. Other columns are ignored.
    """
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = stored(texts.mapInArrow(_split, "doc_id long, word int, start int, stop int, node long, keys array<long>, places array<int>"))
    spots = parts.select(F.explode(F.arrays_zip("keys", "places")).alias("x")).groupBy(F.col("x.keys").alias("key"))
    spots = stored(spots.agg(F.min("x.places").alias("lo"), F.max("x.places").alias("hi")).filter("lo <> hi").select("key"))
    # Combined before it is shuffled by key, so that the many places of a common paragraph come as one row.
    keys = maybe_among(parts.select("node", F.explode("keys").alias("key")), "key", spots, MAP_WORDS).distinct()
    live = stored(keys.join(spots, "key").select("key", "node"))
    comp = classes(parts, live, texts, percent)
    hot = live.select("node").distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    rows = maybe_among(parts.drop("keys", "places"), "node", live.select("node"), MAP_WORDS).join(hot, "node")
    rows = stored(rows.select("doc_id", "word", "start", "stop", "component"))
    # A class whose paragraphs all overlap the one that stays repeats nothing. What a class needs is combined before it is
    # shuffled, and the join that follows is a plain one, in which Spark splits a hot class.
    place = F.struct("doc_id", "word")
    first = rows.groupBy("component").agg(F.min(place).alias("keep"), F.max(place).alias("last"))
    first = first.filter((F.col("last.doc_id") != F.col("keep.doc_id")) | (F.col("last.word") >= F.col("keep.word") + PARAGRAPH)).drop("last")
    rows = rows.join(first, "component")
    same = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("word") < F.col("keep.word") + PARAGRAPH)
    rows = rows.select("doc_id", "word", "start", "stop", "component", F.col("keep.doc_id").alias("keep"), (~same).alias("removed"))
    order = Window.partitionBy("doc_id", "removed").orderBy("word", "start")
    before = F.max("word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("word") > before + REACH, F.lit(True)).cast("int")
    rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    merged = rows.groupBy("doc_id", "removed", "run").agg(
        F.min("start").alias("start"),
        (F.max("stop") - F.min("start")).cast("long").alias("length"),
        (F.max("word") - F.min("word") + PARAGRAPH).cast("long").alias("n_words"),
        F.min("keep").alias("keep_doc_id"),
        F.sort_array(F.collect_set("component")).alias("components"),
    )
    return merged.select("doc_id", F.col("start").cast("long").alias("start"), "length", "n_words", "removed", "keep_doc_id", "components")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
