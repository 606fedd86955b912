"""N-gram Jaccard self-join of documents by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_among, steps, stored, table
from .graph import bucket_components
from .textops import mix, words

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
SHINGLE = 3
#: Counters of the frequency sketch; they order tokens and never decide about a link.
COUNTERS = 1 << 20
BLOCK = 1 << 14
#: Tokens that the sketch counts in at most so many documents are rare, at any size; it never counts too few.
RARE = 256
#: 64-bit words of a set's parity, and of the second one that sets of LARGE and more shingles have.
PARITY_WORDS, LARGE, LARGE_WORDS = 8, 1500, 64
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles; with fewer words, one for all; without words, none."""
    w = words(texts, lower=True)
    own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w.distinct.to_pylist()), np.uint64, len(w.distinct))
    h = own[w.codes] if len(own) else np.zeros(0, np.uint64)
    ends = w.ends
    with np.errstate(over="ignore"):
        odd = np.array([pow(int(_A), i + 1, 1 << 64) | 1 for i in range(k)], np.uint64)
        full = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            full = mix(full + h[i : len(h) - k + 1 + i] * odd[i])
        for end, n in zip(ends.tolist(), w.per_text.tolist(), strict=True):
            if n >= k:
                yield np.unique(full[end - n : end - k + 1])
            elif n:
                x = np.uint64(n)
                for i in range(n):
                    x = mix(x * _B + h[end - n + i] * _C)
                yield np.array([x], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, digest of each document's set; and, as rows with a block, each task's counts of its documents' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(COUNTERS, np.uint32)
        for batch in steps(batches):
            sets = list(shingle_sets(batch.column(1), k))
            counts += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            n, none = [len(x) for x in sets], [None] * len(sets)
            digests = [blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield rows(batch.column(0), n, digests, none, none)
        part = TaskContext.get().partitionId() % 256
        used = [b for b in range(COUNTERS // BLOCK) if counts[b * BLOCK : (b + 1) * BLOCK].any()]
        yield rows([part] * len(used), [None] * len(used), [None] * len(used), used, [counts[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in used])

    def rows(*columns) -> pa.RecordBatch:
        kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, block int, counts binary")


def token_counts(found: DataFrame) -> np.ndarray:
    """The counters summed over all tasks: 256 parts per block first, then whole blocks. COUNTERS numbers at any size."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in rows["counts"]) if len(rows) else None
        return pd.DataFrame({"part": rows["part"].iloc[:1], "block": rows["block"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    schema = "part long, block int, counts binary"
    parts = found.filter("block IS NOT NULL").select(F.col("doc_id").alias("part"), "block", "counts")
    total = parts.groupBy("part", "block").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    counts = np.zeros(COUNTERS, np.uint32)
    for r in total.select("block", "counts").collect():
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint32)
    return counts


def prefix_keys(tokens: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set; level: 0 for rare tokens, higher the more frequent. Two sets that link share a key.

    In any one order of all tokens, here the rare ones first, the first token that two such sets share is among the
    first n - ceil(percent n) + 1 of either: if it is rare, it is a key by itself. Otherwise all that they share is
    frequent, and combinations of two neighbours in the order are keys, of a prefix that is about twice as long. A token
    that only this set has parts two pairs of neighbours, one that only the other has parts one, and with m and e such
    tokens 100 m + percent e <= (100 - percent) n. So at most 2 (100 - percent) n / 100 pairs are parted before the
    first that is whole; the same holds from the other side, so that it is within both prefixes.
    """
    n = len(tokens)
    single, pairs = n - (-(-percent * n // 100)) + 1, 2 * (100 - percent) * n // 100 + 1
    order = np.lexsort((tokens, level))[: pairs + 1]
    tokens, level = tokens[order], level[order]
    often = tokens[level > 0]
    with np.errstate(over="ignore"):
        return np.concatenate((tokens[:single][level[:single] == 0], mix(often[:-1] * _A + mix(often[1:] * _B + _C))))


def parity(tokens: np.ndarray, words_: int) -> np.ndarray:
    """Bit i: whether an odd number of tokens fall on it. Sets that differ in d tokens differ in at most d bits."""
    bits = np.bincount(((tokens >> np.uint64(40)) % np.uint64(64 * words_)).astype(np.int64), minlength=64 * words_) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def index_keys(docs: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, parity, wide, keys of every document whose set can link with a different one."""
    if percent < 75:
        raise ValueError("prefixes of token pairs need a percentage of 75 or more")
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers
    least = -(-100 // (100 - percent)) - 1  # smaller sets link with equal ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if len(s) >= least and doc is not None:
                    seen = shared.value[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    level = np.where(seen > RARE, 1 + np.log2(np.maximum(seen / RARE, 1)).astype(np.int64), 0)
                    wide = parity(s, LARGE_WORDS) if len(s) >= LARGE else None
                    out.append((doc, len(s), parity(s, PARITY_WORDS), wide, prefix_keys(s, level, percent).view(np.int64)))
            doc, n, bits, wide, keys = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n", "parity", "wide", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, parity array<long>, wide array<long>, keys array<long>")


def _may_link(percent: int) -> str:
    """SQL: sizes and parities allow a link. With a smaller and a larger set of a and b tokens, at most (100 - p)/(100 + p) (a + b) tokens differ."""
    bits = " + ".join(f"bit_count(x.m.parity[{i}] ^ y.m.parity[{i}])" for i in range(PARITY_WORDS))
    return f"100 * least(x.m.n, y.m.n) >= {percent} * greatest(x.m.n, y.m.n) AND {100 + percent} * ({bits}) <= {100 - percent} * (x.m.n + y.m.n)"


def _large_may_link(pairs: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) without those of two large sets (doc_id, n, wide) whose wide parities differ too much."""
    x = large.select(F.col("doc_id").alias("a"), F.col("n").alias("x_n"), F.col("wide").alias("x_wide"))
    y = large.select(F.col("doc_id").alias("b"), F.col("n").alias("y_n"), F.col("wide").alias("y_wide"))
    differ = F.expr("aggregate(zip_with(x_wide, y_wide, (a, b) -> bit_count(a ^ b)), 0, (a, b) -> a + b)")
    may = F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("x_n") + F.col("y_n")), F.lit(True))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(may).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by the exact sizes of intersection and union; sets are made of the paired documents only."""
    pairs = stored(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), k)], pa.binary())], ["doc_id", "tokens"])

    sets = maybe_among(texts, "doc_id", ids).mapInArrow(run, "doc_id long, tokens binary")
    sets = stored(sets.join(ids, "doc_id", "left_semi"))

    @F.pandas_udf("boolean")
    def links(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * same >= percent * (len(x) + len(y) - same)

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype=bool)

    own = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("left"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("right"))
    return pairs.join(own, "a").join(other, "b").filter(links("left", "right")).select("a", "b")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents with equal sets are merged first, by digest. Of the rest, two can only link if they share an index key
    (see prefix_keys). Every key's smallest document is tried against the others of the key, the links so found are
    contracted to components, and only then are documents of different components under one key paired, so that a
    large group of near copies costs a few rows per member instead of all its pairs. Sizes and parities rule pairs out
    inside the join; what remains is decided on the whole sets.

    Null text, like one without words, has an empty set and is linked with nothing: component_id is its own id. A null
    id is linked with nothing and has a null component_id. Rows that repeat an id are one node. Other columns are
    ignored.
    """
    texts = _texts(docs, id_col, text_col)
    found = stored(summaries(texts, k))
    rows = found.filter("block IS NULL").select("doc_id", "n", "digest")
    same = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"))
    indexed = index_keys(texts, token_counts(found), k, percent)
    indexed = stored(indexed.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    keys = indexed.select("doc_id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    live = stored(keys.join(shared, "key"))
    active = live.select("doc_id").distinct()
    marks = stored(indexed.drop("keys").join(active, "doc_id", "left_semi"))
    large = marks.filter("wide IS NOT NULL").select("doc_id", "n", "wide")

    comp = bucket_components(
        live.withColumnRenamed("doc_id", "node"),
        marks.select(F.col("doc_id").alias("node"), F.struct("n", "parity").alias("m")),
        _may_link(percent),
        lambda pairs: verified(_large_may_link(pairs, large, percent), texts, k, percent),
    )
    comp = comp.select(F.col("node").alias("rep"), "component")
    whole = same.join(comp, "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component"))
    return rows.join(whole, ["digest", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM d
), g AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), t AS (
  SELECT rep, n, unnest(s) AS x FROM g
), l AS (
  SELECT p.rep AS a, q.rep AS b FROM t p JOIN t q ON p.x = q.x AND p.rep < q.rep AND 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(p.n) + any_value(q.n) - count(*))
), r AS (
  SELECT rep AS a, rep AS b FROM g
  UNION
  SELECT r.a, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON e.a = r.b
), c AS (
  SELECT a AS rep, min(b) AS component FROM r GROUP BY 1
)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(component, s.doc_id) AS component_id FROM s LEFT JOIN g ON g.s = s.s LEFT JOIN c USING (rep)
"""
