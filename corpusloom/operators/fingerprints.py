"""Fingerprints of documents on disk: what is new is compared with them by slices, and no stored text is read again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.corpus import pair_masks, simhash
from corpusloom.operators.index import small
from corpusloom.sources import snapshots

# Most different bits, and most difference in length, of near duplicates.
DISTANCE, TOLERANCE = 3, 0.02

_HASHES = "doc_id long, simhash long, n_chars int, content_hash string, seg int"
_SLICES = "value long, size int, simhash long, n_chars int, first long, seg int, band int"


class FingerprintIndex:
    """Hashes of documents, and slices of the classes of equal hash and length, in segments.

    Every class of equal (simhash, n_chars) has a slice row per pair of distance + 2 slices of 64 bits, of which hashes
    that differ in at most `distance` bits have at least two equal. Slices are stored by band and by ranges of length,
    of which the probing side takes those that the tolerance reaches, so that a probe reads no more than it may find.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.version, self.state = snapshots.current(spark, folder)
        if not self.state:
            raise ValueError(f"no fingerprints in {folder}")
        self.distance, self.tolerance = self.state["distance"], self.state["tolerance"]

    @classmethod
    def create(cls, docs: DataFrame, folder: str, distance: int = DISTANCE, tolerance: float = TOLERANCE) -> FingerprintIndex:
        spark = docs.sparkSession
        snapshots.commit(spark, folder, -1, {"next": 0, "distance": distance, "tolerance": tolerance, "segments": []})
        index = cls(spark, folder)
        index.add(docs)
        return index

    def _read(self, table: str, schema: str) -> DataFrame:
        own = self.state["segments"]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*(f"{self.folder}/{table}/seg={s}" for s in own))

    def _size(self, n: Column, shift: float = 0.0) -> Column:
        return F.floor((F.ln(n) + shift) / max(-8 * math.log(1 - self.tolerance), 0.01)).cast("int")

    @staticmethod
    def hashes(docs: DataFrame) -> DataFrame:
        """doc_id, simhash, n_chars, content_hash; a null text has a null length and hash and is a duplicate of nothing."""
        content = docs.select("doc_id", F.md5("text").alias("content_hash"))
        return simhash(docs, characters=True).join(content, "doc_id").select("doc_id", "simhash", F.col("n_chars").cast("int").alias("n_chars"), "content_hash")

    def _sliced(self, classes: DataFrame) -> DataFrame:
        values = F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in pair_masks(self.distance)])
        return classes.select("*", F.posexplode(values).alias("band", "value"))

    def add(self, docs: DataFrame) -> None:
        """Adds documents (doc_id, text). Only their texts are read. Ids are unique."""
        seg = self.state["next"]
        self.hashes(docs).write.mode("overwrite").parquet(f"{self.folder}/hashes/seg={seg}")
        new = self.spark.read.schema(_HASHES.rsplit(",", 1)[0]).parquet(f"{self.folder}/hashes/seg={seg}")
        classes = new.filter("n_chars IS NOT NULL").groupBy("simhash", "n_chars").agg(F.min("doc_id").alias("first"))
        sliced = self._sliced(classes).withColumn("size", F.when(F.col("n_chars") > 0, self._size(F.col("n_chars"))).otherwise(-1))
        order = ["band", "size", "value"]
        sliced.repartitionByRange(*order).sortWithinPartitions(*order).select("value", "size", "simhash", "n_chars", "first", "band").write.mode("overwrite").partitionBy("band").parquet(f"{self.folder}/slices/seg={seg}")
        self.state = self.state | {"next": seg + 1, "segments": [*self.state["segments"], seg]}
        self.version = snapshots.commit(self.spark, self.folder, self.version, self.state)

    def nearest(self, docs: DataFrame) -> DataFrame:
        """doc_id, original, distance, similarity, action of every new document (doc_id, text).

        The original is the newest stored document (greatest id) with the same text, at similarity 1; else the one with
        the fewest different bits, at most `distance`, and the smallest id among equal ones, whose length differs by at
        most `tolerance` of the longer (any length, if either is 0). action: skip with an original, else index.
        """
        new = snapshots.stored(self.hashes(docs))
        exact = self._read("hashes", _HASHES).filter("content_hash IS NOT NULL").join(small(new.select("content_hash").distinct()), "content_hash", "left_semi")
        exact = exact.groupBy("content_hash").agg(F.max("doc_id").alias("same"))
        asked = new.filter("n_chars IS NOT NULL").groupBy("simhash", "n_chars").agg(F.min("doc_id").alias("asked"))
        near = -math.log(1 - self.tolerance) + 1e-9
        sized = self._sliced(asked.filter("n_chars > 0")).withColumn("size", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(self._size(F.col("n_chars"), -near), self._size(F.col("n_chars"), near)))))
        old = self._read("slices", _SLICES)
        apart = "bit_count(x.simhash ^ y.simhash)"
        close = f"x.band = y.band AND x.value = y.value AND {apart} <= {self.distance}"
        fits = f"(y.n_chars = 0 OR abs(x.n_chars - y.n_chars) <= {self.tolerance} * greatest(x.n_chars, y.n_chars))"
        pick = [F.col("x.simhash").alias("simhash"), F.col("x.n_chars").alias("n_chars"), F.col("y.first").alias("first"), F.expr(apart).alias("distance")]
        found = small(sized).alias("x").join(old.alias("y"), F.expr(f"{close} AND x.size = y.size AND {fits}")).select(pick)
        found = found.union(small(self._sliced(asked.filter("n_chars = 0"))).alias("x").join(old.alias("y"), F.expr(close)).select(pick))
        best = found.groupBy("simhash", "n_chars").agg(F.min(F.struct("distance", "first")).alias("b"))
        rows = new.join(exact, "content_hash", "left").join(best, ["simhash", "n_chars"], "left")
        original = F.coalesce("same", "b.first")
        distance = F.when(F.col("same").isNotNull(), 0).otherwise(F.col("b.distance"))
        similarity = F.when(F.col("same").isNotNull(), 1.0).when(F.col("b").isNotNull(), F.round(1 - F.col("b.distance") / 64, 4)).otherwise(0.0)
        return rows.select("doc_id", original.alias("original"), distance.alias("distance"), similarity.alias("similarity"), F.when(original.isNull(), "index").otherwise("skip").alias("action"))
