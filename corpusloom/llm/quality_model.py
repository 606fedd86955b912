"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled, steps, stored, table
from .langid import gram_counts
from .quality_rules import base_counts

BUCKETS = 2048
#: At most so many different texts, chosen by their hashes, train the scorer.
SAMPLE_DOCS = 3000
KEEP = 0.5
TELLING = 30
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[48:58] = 48
_BYTES[[9, 10, 11, 12, 13]] = 32


def labellers() -> dict[str, Column]:
    """Votes on the counts of base_counts: 1 good, -1 bad, 0 none."""
    n, chars = F.col("n_words"), F.col("word_chars")
    per_word = lambda x: x / F.greatest(n, F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    upper = F.length(F.regexp_replace("t", "[^A-Z]+", "")) / F.greatest(chars, F.lit(1))
    lines = F.size(F.split("t", "\n"))
    ended = F.size(F.split("t", "[.!?\"'](\\s|$)")) - 1
    return {
        "length": vote(n < 3, n >= 50),
        "symbols": vote(per_word(F.col("n_symbols")) > 0.1, per_word(F.col("n_symbols")) < 0.02),
        "lines": vote(F.col("n_dup_lines") > 0.3 * lines, F.col("n_dup_lines") == 0),
        "repeats": vote(F.col("n_repeat_words") > 0.5 * n, F.col("n_repeat_words") < 0.2 * n),
        "word_length": vote((chars < 2.5 * n) | (chars > 12 * n), (chars >= 3 * n) & (chars <= 9 * n)),
        "capitals": vote(upper > 0.3, upper < 0.1),
        "sentences": vote(ended * 60 < n, ended * 30 >= n),
    }


@dataclass
class LabelModel:
    """What every labeller does on good and on bad documents: its rates of bad, no and good votes."""

    prior: float
    rates: np.ndarray  #: labellers x (bad, good document) x (bad, no, good vote)

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeller, over either kind alike: right votes among its votes."""
        right = self.rates[:, 0, 0] + self.rates[:, 1, 2]
        return right / (right + self.rates[:, 0, 2] + self.rates[:, 1, 0])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of good of each row of votes."""
        which = np.arange(votes.shape[1])
        odds = np.log(self.rates[which, 1, votes + 1] / self.rates[which, 0, votes + 1]).sum(1)
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + odds)))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their numbers, which is the same as over all documents.

    It starts from the belief that a single bad vote tells, and holds every labeller to being better than chance: its
    bad votes are at least TELLING times as likely on bad documents (up to one in two) as on good ones.
    """
    p, total = np.where((votes < 0).any(1), 0.1, 0.9), max(1.0, counts.sum())
    for _ in range(rounds):
        kinds = np.stack([(1 - p) * counts, p * counts])
        rates = np.stack([kinds @ (votes == v) for v in (-1, 0, 1)], 2).transpose(1, 0, 2) + 0.5  # labellers x kinds x votes
        rates /= rates.sum(2, keepdims=True)
        bad = np.clip(rates[:, 0, 0], TELLING * np.minimum(rates[:, 1, 0], 0.5 / TELLING), 0.99)
        rates[:, 0, 1:] *= ((1 - bad) / rates[:, 0, 1:].sum(1))[:, None]
        rates[:, 0, 0] = bad
        model = LabelModel(float(np.clip(kinds[1].sum() / total, 0.02, 0.98)), rates)
        p = model.posterior(votes)
    return model


def _vectors(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for at, counts in gram_counts(texts, BUCKETS, _BYTES):
        x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        yield at, x.astype(np.float32)


def fit_scorer(x: np.ndarray, p: np.ndarray, rounds: int = 400, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by full gradients with momentum; either class weighs alike."""
    w, bias, dw, db = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
    good = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
    weight = p * 0.5 / good + (1 - p) * 0.5 / (1 - good)
    for _ in range(rounds):
        g = weight * (p - 1 / (1 + np.exp(-(x @ w + bias)))) / len(p)
        dw, db = 0.9 * dw + (x.T @ g - decay * w), 0.9 * db + g.sum()
        w, bias = w + rate * dw, bias + rate * db * 0.1
    return w, bias


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, keep: float = KEEP) -> DataFrame:
    """One row per input row: doc_id, votes, n_votes, posterior, score, kept.

    votes holds one character per labeller: + good, - bad, 0 none. The accuracies of the labellers come from the
    numbers of all vote patterns, at most three to the number of labellers. A linear model on the hashed byte n-grams of
    whole texts learns the posterior labels from `sample_docs` different texts at most, chosen by hash. kept: the mean of posterior
    and score is at least `keep`.
    Scores of texts without n-grams are their posteriors, as are all scores where fewer than ten documents can train the
    model. Null text counts as empty; null and repeated ids have rows of their own; other columns are ignored.
    """
    heuristics = labellers()
    votes = F.concat(*[F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in heuristics.values()])
    # Stored, as counting takes most of the work and three passes need the votes.
    rows = stored(base_counts(docs, id_col, text_col).select("doc_id", F.col("t").alias("text"), votes.alias("votes")))
    numbers = lambda patterns: np.array([[{"+": 1, "-": -1}.get(c, 0) for c in v] for v in patterns], int).reshape(-1, len(heuristics))
    found = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    labels = fit_labels(numbers(found), np.array(list(found.values()), float))
    posterior = dict(zip(found, labels.posterior(numbers(found)).tolist(), strict=True))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for at, x in _vectors(batch.column(0)):
                own = batch.column(1).slice(at, len(x))
                yield pa.RecordBatch.from_arrays([own, pa.array([v.tobytes() for v in x], pa.binary())], ["votes", "x"])

    few = sampled(rows.filter("text <> ''").select("text", "votes"), "text", sample_docs)
    got = sorted((r["votes"], bytes(r["x"])) for r in few.mapInArrow(sample, "votes string, x binary").collect())
    w, bias = None, 0.0
    if len(got) >= 10:
        x = np.stack([np.frombuffer(v, np.float32) for _, v in got]).astype(float)
        w, bias = fit_scorer(x, np.array([posterior[v] for v, _ in got]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            patterns = batch.column(2).to_pylist()
            p = np.array([posterior[v] for v in patterns])
            score = p.copy()
            if w is not None:
                for at, x in _vectors(batch.column(1)):
                    some = x.any(1)
                    score[at : at + len(x)][some] = 1 / (1 + np.exp(-(x[some] @ w + bias)))
            voted = [len(v) - v.count("0") for v in patterns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(voted, pa.int32()), pa.array(p), pa.array(score), pa.array((p + score) / 2 >= keep)],
                ["doc_id", "votes", "n_votes", "posterior", "score", "kept"],
            )

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "votes").mapInArrow(
        run, "doc_id long, votes string, n_votes int, posterior double, score double, kept boolean"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))
