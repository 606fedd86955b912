"""Language identification by error-correcting output codes over hashed n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_steps, table
from .textops import utf8

BUCKETS = 8192
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: n-grams after which a text's evidence counts in full.
FULL_EVIDENCE = 60
#: A text is ambiguous when the nearest codeword's score is below this.
CLEAR = 0.6
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; numbers such as ² or Ⅷ are not, though they count as word characters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by the CRC of its id; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def gram_counts(texts: pa.Array, buckets: int = BUCKETS, plain: np.ndarray = _PLAIN) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, counts of texts x buckets) for a few texts at a time: byte n-grams after the byte map `plain`, with runs of spaces as one."""
    raw, bounds = utf8(texts)
    raw = plain[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    keep[bounds[:-1][bounds[:-1] < len(raw)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    raw, bounds = raw[keep].astype(np.uint32), kept[bounds]
    few = max(1, (4 << 20) // buckets)
    for at in range(0, len(texts), few):
        to = min(len(texts), at + few)
        part = raw[bounds[at] : bounds[to]]
        row = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
        counts = np.zeros((to - at) * buckets, np.float64)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] if n > 1 else part + np.uint32(1)
            if n in ORDERS and len(code):
                slot = ((code * np.uint32(2654435761)) ^ np.uint32(n * 40503)) >> np.uint32(32 - int(buckets).bit_length() + 1)
                inside = row[: len(code)] == row[n - 1 :]
                counts += np.bincount((row[: len(code)] * buckets + slot)[inside], minlength=len(counts))
        yield at, counts.reshape(to - at, buckets)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k x bits of -1 and 1: every split of the classes in two for up to five classes, else 10 log2(k) different random splits."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 5:
        return np.array([[1 if (n >> (c - 1)) & 1 else -1 for n in range(1, 1 << (k - 1))] if c else [-1] * ((1 << (k - 1)) - 1) for c in range(k)])
    rng, found = np.random.default_rng(seed), {}
    while len(found) < int(np.ceil(10 * np.log2(k))):
        column = rng.permutation(np.where(np.arange(k) < k // 2, 1, -1))
        found.setdefault(tuple((column * column[0]).tolist()), column)
    return np.array(list(found.values())).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  #: languages x bits
    weights: np.ndarray  #: buckets x bits, log-odds of an n-gram
    trust: np.ndarray  #: languages x bits, how much a bit says about a language; rows sum to 1

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest codeword and its score: the share of exp(-loss) among all codewords."""
        n = counts.sum(1)
        if len(self.languages) == 1:
            return np.zeros(len(n), int), np.ones(len(n))
        margin = (counts @ self.weights) * (np.minimum(n, FULL_EVIDENCE) / np.maximum(n, 1))[:, None]
        loss = np.einsum("tlb,lb->tl", np.logaddexp(0, -margin[:, None, :] * self.code[None]), self.trust)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / p.sum(1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> Model | None:
    """The model from all documents that aren't held out and have a language; None if there are none.

    Every task sums the n-grams per language, groups of tasks are summed next, and the driver gets languages x buckets.
    A bit's classifier has for each n-gram the log-odds between the languages on either side, each language weighing alike.
    """
    schema = "lang string, part int, counts binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[str, np.ndarray] = {}
        for batch in small_steps(batches):
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, counts in gram_counts(batch.column(0), buckets):
                own = langs[at : at + len(counts)]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + counts[own == lang].sum(0)
        part = TaskContext.get().partitionId() % 512
        yield pa.RecordBatch.from_pydict(
            {"lang": list(sums), "part": [part] * len(sums), "counts": [x.astype("<f8").tobytes() for x in sums.values()]},
            schema=pa.schema([("lang", pa.string()), ("part", pa.int32()), ("counts", pa.binary())]),
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f8") for x in rows["counts"])
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    learn = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = learn.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(local, schema)
    sums = sums.groupBy("lang", "part").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema)
    found = sorted((r["lang"], np.frombuffer(r["counts"], "<f8")) for r in sums.collect())
    if not found:
        return None
    table_ = np.array([c for _, c in found]) + 0.5
    share = table_ / table_.sum(1, keepdims=True)
    code = codewords(len(found))
    weights = np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1) if code.shape[1] else np.zeros((buckets, 0))
    trust = np.maximum(code * (share @ weights), 1e-6)
    return Model([x for x, _ in found], code, weights, trust / trust.sum(1, keepdims=True) if code.shape[1] else trust)


def _decided(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """lang_pred and score of every text."""
    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
    if model is not None:
        for at, counts in gram_counts(texts, model.weights.shape[0]):
            best[at : at + len(counts)], score[at : at + len(counts)] = model.decode(counts)
    letters = [model is not None and t is not None and has_letter(t) for t in texts.to_pylist()]
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)]
    return names, np.where(letters, score, 0.0)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, ambiguous.

    Only the row's own text counts. Of languages whose codewords are as near, the first in the alphabet is chosen. lang_pred is `und`, with score 0, for a null text, one without a letter, and without a model.
    ambiguous: und, or a score below CLEAR. Null and repeated ids have rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_steps(batches):
            names, score = _decided(batch.column(2), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(score < CLEAR)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_clear(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose own text has a clear language, with all columns; lang_col becomes the predicted language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_steps(batches, text_col):
            names, score = _decided(batch.column(batch.schema.get_field_index(text_col)), model)
            at = batch.schema.get_field_index(lang_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(names, batch.schema.field(at).type))
            yield batch.filter(pa.array(score >= CLEAR))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
