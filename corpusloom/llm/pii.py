"""Personal data: base patterns, and further spans that boosted trees choose among overlapping candidates."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_steps, stored, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Parts of the texts: a text's model has learned from the texts of the others.
FOLDS = 5
#: Precision, by weak labels of candidates that their model hasn't seen, that sets the threshold of added spans.
PRECISION = 0.99

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORTH = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's matches from the left: the run of local characters up to each @, if a domain follows."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the base patterns by kind, and the matches that failed their rule."""
    good: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    bad: list[Span] = []
    for m in _IP.finditer(text):
        (good if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))) else bad).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        (good if 13 <= len(digits) <= 19 and luhn(digits) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 9 <= sum(c in "0123456789" for c in m[0]) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


#: Generators of candidates, made to miss little: kind and pattern; a group, if there is one, is the span. They take whole
#: runs of any length, from the run's start and without giving back what they read, so that the time is linear.
GENERATORS = (
    ("number", re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9\x20().-]{5,}[0-9](?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]*+[0-9])[0-9A-Za-z_/+-]{12,}+")),
    ("secret", re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|auth)[\x20\"']{0,3}[=:][\x20\"']{0,3}([^\s\"',;]{6,}+)")),
    ("contact", re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]{2,}+")),
)
_CUE = re.compile(r"(?i)(password|passwd|pwd|secret|token|key|auth|card|visa|account|phone|tel|call|mail|ssn|iban)[^A-Za-z0-9]{0,6}$")
#: Formats that are personal data or secrets for certain; they label candidates.
_CERTAIN = re.compile(r"AKIA[0-9A-Z]{16}|(?:sk|ghp)[-_][0-9A-Za-z]{20,}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
_ASSIGNED = re.compile(r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)[\x20\"']{0,3}[=:][\x20\"']{0,3}$")
FEATURES = 17

_COUNT = [*range(128), *(int(128 * 1.1**i) for i in range(1, 120))]
_SHARE, _BITS, _FLAG = [(i + 0.5) / 100 for i in range(100)], [(i + 0.5) / 25 for i in range(199)], [0.5]
#: Bounds of the bins of each feature, the same for all tables; value x is in bin i where CUTS[f][i - 1] < x <= CUTS[f][i].
CUTS = [[0.5, 1.5, 2.5], _COUNT, *[_SHARE] * 4, _BITS, _SHARE, _COUNT, _COUNT, *[_FLAG] * 7]
#: Most bins of a feature; parts of 1 in which gradients are added up as integers, so that their order changes nothing; steps
#: between scores of 0 and 1.
BINS, PARTS, SCORES = 256, 1 << 20, 1 << 16


def candidates(text: str) -> list[Span]:
    found = {(kind, *m.span(m.lastindex or 0)) for kind, pattern in GENERATORS for m in pattern.finditer(text)}
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def worth(text: str) -> bool:
    """Whether any base pattern or generator may match: all need a digit or an @, but for assigned values."""
    return _WORTH.search(text) is not None or GENERATORS[2][1].search(text) is not None


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate; all counts are over the whole span."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 1]
    n = len(s)
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_digit = (code >= 48) & (code <= 57)
    digit, upper, lower = is_digit.mean(), ((code >= 65) & (code <= 90)).mean(), ((code >= 97) & (code <= 122)).mean()
    share = np.unique(code, return_counts=True)[1] / n
    edge = np.flatnonzero(np.diff(is_digit.astype(np.int8), prepend=0, append=0))
    groups = edge[1::2] - edge[::2]
    digits = int(groups.sum())
    return [
        float([k for k, _ in GENERATORS].index(kind)),
        n,
        digit,
        upper,
        lower,
        1 - digit - upper - lower,
        float(-(share * np.log2(share)).sum()),
        np.count_nonzero(is_digit[1:] != is_digit[:-1]) / n,
        len(groups),
        groups.max(initial=0),
        float((is_digit | ((code >= 97) & (code <= 102))).all()),
        float(_CUE.search(before) is not None),
        float(before.rstrip()[-1:] in "=:" and bool(before.strip())),
        float(before[-1:] in "\"'" and before != ""),
        float(after in ("", " ", "\n", ".", ",", '"', "'")),
        float("@" in s),
        float(13 <= digits <= 19 and luhn("".join(re.findall("[0-9]", s)))),
    ]


class Held:
    """Asks whether one of many spans holds another: by start, with the furthest end so far."""

    def __init__(self, spans: list[Span]):
        own = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends = [a for a, _ in own], list(accumulate((b for _, b in own), max))

    def __call__(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


class Taken:
    """Disjoint stretches of a text, sorted, to which others are added unless they overlap one."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i == len(self.starts) or self.starts[i] >= b

    def add(self, a: int, b: int) -> bool:
        """Whether a:b was free; it is taken now."""
        i = bisect_right(self.ends, a)
        if not self.free(a, b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def weak_label(text: str, span: Span, good: Held, bad: Held) -> int | None:
    """1: certain formats, assigned values and base spans; 0: matches that failed their rule and words beside digits; None: unknown."""
    _, a, b = span
    if good(a, b) or _CERTAIN.fullmatch(text, a, b):
        return 1
    if _ASSIGNED.search(text[max(0, a - 24) : a]) and re.search("[0-9]", text[a:b]):
        return 1
    if bad(a, b):
        return 0
    return 0 if len(re.findall("[0-9]", text[a:b])) * 5 < b - a else None


def binned(x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(CUTS)], 1).astype(np.uint8)


@dataclass
class Trees:
    """Boosted trees of depth two over binned features, and the score from which on a span is added."""

    trees: list[tuple]
    bias: float
    threshold: float

    def of(self, text: str) -> Trees:
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.score_bins(binned(x))

    def score_bins(self, bins: np.ndarray) -> np.ndarray:
        return np.floor(self.likely(bins) * SCORES) / SCORES

    def likely(self, bins: np.ndarray) -> np.ndarray:
        z, columns = np.full(len(bins), self.bias), np.ascontiguousarray(bins.T)
        for (f, c), (lf, lc), (rf, rc), leaves in self.trees:
            z += np.array(leaves)[np.where(columns[f] <= c, columns[lf] > lc, 2 + (columns[rf] > rc))]
        return 1 / (1 + np.exp(-z))


@dataclass
class Folds:
    """One model per fold of texts, which has learned from the texts of the other folds only, and one threshold for all."""

    models: list[Trees]
    threshold: float

    def of(self, text: str) -> Trees:
        return self.models[fold_of(text)]


def fold_of(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % FOLDS


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All weakly labelled candidates of all different texts: fold, y (label), free (whether it may be added), bins (of its
    features), and n, how many candidates are alike in these.

    A text counts once, however many rows have it. The candidates, not the texts, are shuffled.
    """
    names, types = ["digest", "place", "fold", "y", "free", "bins"], [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def packed(rows: list[tuple], x: list[list[float]]) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True), [b.tobytes() for b in binned(np.array(x))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_steps(batches, most=4 << 20):
            rows, x = [], []
            for text in batch.column(0).to_pylist():
                if not worth(text):
                    continue
                base, failed = base_spans(text)
                good, bad, taken = Held(base), Held(failed), Taken(base)
                digest, fold = hashlib.md5(text.encode()).digest(), fold_of(text)
                for place, s in enumerate(candidates(text)):
                    label = weak_label(text, s, good, bad)
                    if label is None:
                        continue
                    rows.append((digest, place, fold, label, taken.free(s[1], s[2])))
                    x.append(features(text, s))
                    if len(rows) == 8192:
                        yield packed(rows, x)
                        rows, x = [], []
            if rows:
                yield packed(rows, x)

    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "digest binary, place int, fold int, y int, free boolean, bins binary")
    return found.distinct().groupBy("fold", "y", "free", "bins").agg(F.count(F.lit(1)).alias("n"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """fold, y, free, bins and n of a batch of `labelled`."""
    fold, y, free, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fold", "y", "free", "n"))
    bins = batch.column(batch.schema.get_field_index("bins")).to_pylist()
    return fold, y, free, np.frombuffer(b"".join(bins), np.uint8).reshape(-1, FEATURES), n


def gradients(rows: DataFrame, models: list[Trees], roots: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, added up over all rows by model, side of its root (with `roots`: feature and
    bin of each), feature and bin; a model's own fold doesn't count."""
    shape = (FOLDS, 2, FEATURES, BINS)
    size, offset = 2 * FEATURES * BINS, np.arange(FEATURES) * BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FOLDS, size))
        for batch in batches:
            fold, y, _, bins, n = _arrays(batch)
            for i, m in enumerate(models):
                p, weight = m.likely(bins), n * (fold != i)
                side = 0 if roots is None else (bins[:, roots[i][0]] > roots[i][1])[:, None] * (FEATURES * BINS)
                at = (side + offset + bins).ravel()
                for k, v in enumerate((y - p, p * (1 - p))):
                    sums[k, i] += np.bincount(at, np.repeat(np.rint(v * PARTS) * weight, FEATURES), size)
        g, h = sums.reshape(2, -1).astype(np.int64)
        cell = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(g[cell]), pa.array(h[cell])], ["cell", "g", "h"])

    cells = rows.mapInArrow(run, "cell int, g long, h long").groupBy("cell")
    out = np.zeros((2, FOLDS * size))
    for r in cells.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[:, r["cell"]] = r["g"] / PARTS, r["h"] / PARTS
    return out[0].reshape(shape), out[1].reshape(shape)


def quantiles(count: np.ndarray) -> np.ndarray:
    """Whether a bin holds one of 24 quantiles of its feature, by rows that are counted by feature and bin."""
    share = np.cumsum(count, 1) / count.sum(1, keepdims=True)
    out = np.zeros(count.shape, bool)
    for f, own in enumerate(share):
        out[f, np.searchsorted(own, np.linspace(0.02, 0.98, 24))] = True
    return out


def split(g: np.ndarray, h: np.ndarray, cuts: np.ndarray) -> tuple[int, int]:
    """Feature and bin of the best split, after one of the bins `cuts`, of a node's sums by feature and bin; of equal ones the first."""
    lg, lh = np.cumsum(g, 1), np.cumsum(h, 1)
    gain = lg**2 / (lh + 1) + (lg[:, -1:] - lg) ** 2 / (lh[:, -1:] - lh + 1)
    f, c = np.unravel_index(np.where(cuts, gain, -1).argmax(), gain.shape)
    return int(f), int(c)


def boost(rows: DataFrame, rounds: int = 40, rate: float = 0.3) -> list[Trees] | None:
    """Gradient boosting with the logistic loss, for every fold on the other folds' rows of `labelled`: two passes over all
    rows a round, one for the roots of all models' trees and one for both sides. The driver gets sums by bin only. Trees
    split at quantiles by counts of all rows that their model learns from.

    None where a model has too little or but one class to learn from.
    """
    n, right = np.zeros(FOLDS), np.zeros(FOLDS)
    for r in rows.groupBy("fold").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("right")).collect():
        n[r["fold"]], right[r["fold"]] = r["n"], r["right"]
    n, right = n.sum() - n, right.sum() - right
    if (n < 20).any() or (right == 0).any() or (right == n).any():
        return None
    mean = right / n
    models = [Trees([], float(b), 2.0) for b in np.log((mean + 1e-3) / (1 - mean + 1e-3))]
    cuts = None
    for _ in range(rounds):
        g, h = gradients(rows, models)
        if cuts is None:  # before the first tree, h is the same for every row, so that its sums count rows
            cuts = [quantiles(h[i, 0]) for i in range(FOLDS)]
        roots = [split(g[i, 0], h[i, 0], cuts[i]) for i in range(FOLDS)]
        g, h = gradients(rows, models, roots)
        for i, m in enumerate(models):
            sides, leaves = [split(g[i, s], h[i, s], cuts[i]) for s in (0, 1)], []
            for s, (f, c) in enumerate(sides):
                for part in (slice(c + 1), slice(c + 1, None)):
                    leaves.append(rate * float(g[i, s, f, part].sum() / (h[i, s, f, part].sum() + 1)))
            m.trees.append((roots[i], *sides, leaves))
    return models


def added_scores(rows: DataFrame, models: list[Trees]) -> DataFrame:
    """How many rows that may be added have a score of 0.5 or more, each scored by the model that hasn't seen its text, and how
    many of them are right: score (in steps of 1 / SCORES), n, right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y, free, bins, n = _arrays(batch)
            score = np.zeros(len(n))
            for i, m in enumerate(models):
                score[fold == i] = m.score_bins(bins[fold == i])
            use = free.astype(bool) & (score >= 0.5)
            columns = [pa.array((score[use] * SCORES).astype(np.int32)), pa.array(n[use]), pa.array(n[use] * y[use])]
            yield pa.RecordBatch.from_arrays(columns, ["score", "n", "right"])

    found = rows.mapInArrow(run, "score int, n long, right long")
    return found.groupBy("score").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))


def lowest_score(p: np.ndarray, t: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The lowest score of 0.5 or more at which those that reach it are right often enough; 2 if there is none.

    An entry of p stands for n candidates (1 if not given), t of which are right. All that have the same score pass or
    fail together, so precision counts at the ends of equal scores only.
    """
    order = np.argsort(-p, kind="stable")
    p, right = p[order], np.cumsum(t[order]) / np.cumsum(np.ones(len(t)) if n is None else n[order])
    last = np.append(p[1:] != p[:-1], True)
    enough = np.flatnonzero(last & (right >= precision) & (p >= 0.5))
    return float(p[enough[-1]]) if len(enough) else 2.0


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Folds | None:
    """Models from all weakly labelled candidates of all texts, and the threshold at which those that may be added are right
    often enough. A hash of the whole text says which fold it is in, and copies of a text count once."""
    rows = stored(labelled(docs, text_col))
    models = boost(rows)
    if models is None:
        return None
    found = added_scores(rows, models).collect()
    if not found:
        return Folds(models, 2.0)
    score, n, right = (np.array([r[c] for r in found]) for c in ("score", "n", "right"))
    return Folds(models, lowest_score(score / SCORES, right, precision, n))


def all_spans(text: str, model: Trees | Folds | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and the candidates that the model adds: best score first, none that overlaps an earlier one."""
    good, _ = base_spans(text)
    added: list[Span] = []
    if model is not None:
        left = candidates(text)
        if left:
            scores = model.of(text).score(np.array([features(text, s) for s in left]))
            taken = Taken(good)
            for i in np.lexsort(([s[1] for s in left], -scores)).tolist():
                kind, a, b = left[i]
                if scores[i] >= model.threshold and taken.add(a, b):
                    added.append((kind, a, b))
    return good, added


def _joined(spans: list[Span]) -> str:
    place = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (place.get(s[0], len(KINDS)), s[0], s[1], s[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by <KIND> of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: Trees | Folds | None, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and with redact: redacted).

    The base patterns always count; the model adds spans of further kinds that overlap neither them nor one another.
    Null text counts as empty and stays without spans. Null and repeated ids have rows of their own. Other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_steps(batches, most=4 << 20):
            n = {k: [] for k in KINDS}
            digests, spans, texts = [], [], []
            for text in batch.column(1).to_pylist():
                good, added = all_spans(text, model) if worth(text) else ([], [])
                for k in KINDS:
                    n[k].append(sum(s[0] == k for s in good))
                digests.append(hashlib.sha256(_joined(good).encode()).hexdigest())
                spans.append(_joined(good + added))
                if redact:
                    texts.append(redacted(text, good + added))
            columns = [batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if redact:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema + ", redacted string" * redact)


def redact_column(docs: DataFrame, model: Trees | Folds | None, text_col: str = "text") -> DataFrame:
    """`docs` with all its columns, the personal data in its texts replaced by <KIND>. A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_steps(batches, text_col, 4 << 20):
            at = batch.schema.get_field_index(text_col)
            texts = [t and (redacted(t, sum(all_spans(t, model), [])) if worth(t) else t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs))
