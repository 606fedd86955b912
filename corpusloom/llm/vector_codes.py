"""Product codes of vectors by Lloyd's rounds over cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .intvec import blocks, matrix, reach, scaled, squared, usable, width

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of one forest, and points of a node that is compared point by point.
BLOCK, LEAF = 8192, 8
#: Relative room for rounding in comparisons of distances; only nodes that are further apart are decided without integers.
SLACK = 1e-9
#: Groups of labels whose sums go to every task.
FEW_LABELS = 200_000


@dataclass
class Forest:
    """One cover tree per part of a block. Node i holds the points order[start[i]:stop[i]], all within radius[i] of its centre, a point.

    Its children, nodes first_child[i] to last_child[i], cover its points within half its radius, their centres are
    further apart than that, and one of them has its own centre. sums: of its points, componentwise.
    """

    order: np.ndarray  #: points (part * vectors + vector), so that every node is a range
    part: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first_child: np.ndarray
    last_child: np.ndarray
    sums: np.ndarray

    def to_bytes(self) -> list[bytes]:
        kind = {"radius": "<f8", "sums": "<i8"}
        return [np.ascontiguousarray(getattr(self, f.name)).astype(kind.get(f.name, "<i4")).tobytes() for f in fields(self)]

    @staticmethod
    def from_bytes(raw: list[bytes], wide: int) -> Forest:
        kind = {"radius": "<f8", "sums": "<i8"}
        arrays = {f.name: np.frombuffer(x, kind.get(f.name, "<i4")) for f, x in zip(fields(Forest), raw, strict=True)}
        return Forest(**arrays | {"sums": arrays["sums"].reshape(len(arrays["start"]), wide)})


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    n = stop - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n), owner


def plant(points: np.ndarray, parts: int) -> Forest:
    """The forest of points (parts * vectors, components), the vectors' first parts first; all trees grow level by level at once."""
    each = len(points) // parts
    order = np.arange(len(points))
    start, stop = np.arange(parts) * each, (np.arange(parts) + 1) * each
    part, centre = np.arange(parts), start.copy()
    levels, made = [], 0
    while len(start):
        at, owner = _ranges(start, stop)
        far = squared(points[order[at]], points[centre[owner]])
        heads = np.cumsum(stop - start) - (stop - start)
        radius = np.sqrt(np.maximum.reduceat(far, heads).astype(float))
        total = np.add.reduceat(points[order[at]], heads, axis=0)
        grow = np.flatnonzero((stop - start > LEAF) & (radius > 0))
        made += len(start)
        level = {"part": part, "centre": centre, "radius": radius, "start": start, "stop": stop, "sums": total}
        # Greedy covers of all growing nodes side by side: the node's centre first, then ever the first point that is left.
        at, owner = _ranges(start[grow], stop[grow])
        mine, half = order[at], (radius[grow] / 2)[owner]
        child, of = np.full(len(at), -1), np.zeros(len(at), np.int64)
        left, now, turn = np.arange(len(at)), centre[grow], 0
        while len(left):
            near = np.sqrt(squared(points[mine[left]], points[now[owner[left]]]).astype(float)) <= half[left]
            child[left[near]], of[left[near]] = turn, now[owner[left[near]]]
            left, turn = left[~near], turn + 1
            if len(left):
                first = np.flatnonzero(np.diff(owner[left], prepend=-1))
                now = now.copy()
                now[owner[left[first]]] = mine[left[first]]
        rank = np.lexsort((child, owner))
        order[at] = mine[rank]
        key = owner[rank] * (turn + 1) + child[rank]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        born = np.bincount(owner[rank][new], minlength=len(grow))
        first, last = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        ends = made + np.cumsum(born)
        first[grow], last[grow] = ends - born, ends
        levels.append(level | {"first_child": first, "last_child": last})
        part, centre = part[grow][owner[rank][new]], of[rank][new]
        start = at[new]
        stop = np.append(at[new[1:] - 1] + 1, at[-1:] + 1) if len(new) else start
    return Forest(order=order, **{k: np.concatenate([x[k] for x in levels]) for k in levels[0]})


def _least(pair_row: np.ndarray, far: np.ndarray, entry: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n rows, whose pairs are adjacent: the nearest entry, the lower one of equals, and its squared distance."""
    heads = np.searchsorted(pair_row, np.arange(n))
    least = np.minimum.reduceat(far, heads)
    number = np.where(far == least[pair_row], entry, np.iinfo(np.int64).max)
    return np.minimum.reduceat(number, heads), least


def assign(points: np.ndarray, forest: Forest, books: np.ndarray, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts per part and entry, and with `codes` every point's entry and squared distance.

    books: parts x entries x components. From the roots down, a node drops the entries that are further from its centre
    than the nearest one by more than twice its radius; by the triangle inequality none of its points is nearest to
    them. A node with one entry left gives it all its points at once, others go on with what is left to their children,
    and to exact comparisons of points at leaves. Equal distances are never decided by bounds.
    """
    parts, k, wide = books.shape
    sums, counts = np.zeros((parts, k, wide), np.int64), np.zeros((parts, k), np.int64)
    code = np.zeros(len(points), np.int64)
    flat = books.reshape(parts * k, wide)
    node = np.repeat(np.arange(parts), k)
    entry = np.tile(np.arange(k), parts)

    def give(nodes: np.ndarray, to: np.ndarray) -> None:
        np.add.at(sums, (forest.part[nodes], to), forest.sums[nodes])
        np.add.at(counts, (forest.part[nodes], to), (forest.stop - forest.start)[nodes])
        if codes:
            at, owner = _ranges(forest.start[nodes].astype(np.int64), forest.stop[nodes].astype(np.int64))
            code[forest.order[at]] = to[owner]

    while len(node):
        open_, row = np.unique(node, return_inverse=True)
        far = squared(points[forest.centre[node]], flat[forest.part[node].astype(np.int64) * k + entry])
        best, least = _least(row, far, entry, len(open_))
        radius = forest.radius[open_]
        same = radius == 0
        near = np.sqrt(far.astype(float))
        keep = near * (1 - SLACK) <= (np.sqrt(least.astype(float)) + 2 * radius)[row] * (1 + SLACK)
        left = np.bincount(row[keep], minlength=len(open_))
        done = same | (left == 1)
        give(open_[done], best[done])
        keep &= ~done[row]
        row, entry = row[keep], entry[keep]
        heads = np.searchsorted(row, np.arange(len(open_) + 1))
        leaf = ~done & (forest.first_child[open_] == forest.last_child[open_])
        # Leaves: every point against the entries that are left.
        at, owner = _ranges(forest.start[open_[leaf]].astype(np.int64), forest.stop[open_[leaf]].astype(np.int64))
        if len(at):
            of = np.flatnonzero(leaf)[owner]
            pair, who = _ranges(heads[of], heads[of + 1])
            mine = forest.order[at].astype(np.int64)
            got, _ = _least(who, squared(points[mine[who]], flat[forest.part[open_[of]][who].astype(np.int64) * k + entry[pair]]), entry[pair], len(at))
            np.add.at(sums, (forest.part[open_[of]], got), points[mine])
            np.add.at(counts, (forest.part[open_[of]], got), 1)
            code[mine] = got
        # Inner nodes: their children with the entries that are left.
        inner = np.flatnonzero(~done & ~leaf)
        kids, owner = _ranges(forest.first_child[open_[inner]].astype(np.int64), forest.last_child[open_[inner]].astype(np.int64))
        of = inner[owner]
        pair, who = _ranges(heads[of], heads[of + 1])
        node, entry = kids[who], entry[pair]
    each = len(points) // parts
    part = np.repeat(np.arange(parts), each)
    error = squared(points, flat[part * k + code]) if codes else np.zeros(0, np.int64)
    return sums, counts, code, error


def _points(v: np.ndarray, parts: int) -> np.ndarray:
    """The parts of n vectors as rows, all first parts first; the last ones end with zeros where parts don't come out even."""
    n, dim = v.shape
    wide = -(-dim // parts)
    v = np.pad(v, ((0, 0), (0, wide * parts - dim)))
    return np.ascontiguousarray(v.reshape(n, parts, wide).transpose(1, 0, 2)).reshape(n * parts, wide)


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per usable vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Every task plants cover trees over blocks of `block` vectors, once; the trees are stored and read by all rounds. A
    round sends the codebooks to the tasks and gets parts x entries sums, which the shuffle combines, so that what
    travels doesn't grow with the vectors.

    Null vectors and those with a null, NaN or infinite component are left out, and so are vectors of another length
    than the one of the smallest id (null ids last; of equal ids, the shortest). Components are floor(scale * x), kept
    within +-2^27 for 64 components so that all distances fit 64 bits. Parts that don't come out even end with zeros.
    Codebooks start from the smallest ids (of equal ids, the smaller vectors; null ids last); fewer vectors give fewer
    entries. Repeated rows and ids are rows of their own. Null labels are one label. A label_error beyond 64 bits is
    null. No usable vector gives no row. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"
    dim = width(rows, "vec_id", "v")
    if dim is None:
        return spark.createDataFrame([], schema + ", label_error long, codebooks_sha256 string")
    kept = rows.filter(F.size("v") == dim).withColumn("v", scaled(F.col("v"), scale, dim))
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = _points(np.array([r["v"] for r in first], np.int64).reshape(len(first), dim), parts).reshape(parts, len(first), -1)
    wide = books.shape[2]
    names = [f.name for f in fields(Forest)]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, block):
            points = _points(matrix(b.column(2), dim), parts)
            trees = plant(points, parts)
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(i)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([points.astype("<i8").tobytes()]), *(pa.array([x]) for x in trees.to_bytes())], ["vec_id", "label", "points", *names])

    forest = stored(kept.select("vec_id", "label", "v").mapInArrow(grow, f"vec_id array<long>, label array<{kind}>, points binary, " + ", ".join(f"`{x}` binary" for x in names)))

    def trees_of(row: dict) -> tuple[np.ndarray, Forest]:
        return np.frombuffer(row["points"], "<i8").reshape(-1, wide), Forest.from_bytes([row[x] for x in names], wide)

    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    s, c, _, _ = assign(*trees_of(batch.slice(i, 1).to_pylist()[0]), books)
                    sums, counts = sums + s, counts + c
            cell = np.arange(counts.size)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, wide), pa.int32()), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(counts.reshape(-1)), flat], ["cell", "n", "sums"])

        part_sums = forest.select("points", *names).mapInArrow(summed, "cell int, n long, sums array<long>")
        both = part_sums.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(wide)))
        new = books.reshape(-1, wide).copy()
        for r in both.filter("n > 0").collect():  # parts * entries rows at most
            new[r["cell"]] = [r[f"s{i}"] // r["n"] for i in range(wide)]
        books = new.reshape(books.shape)

    def coded(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, _, code, error = assign(*trees_of(row.select(["points", *names]).to_pylist()[0]), books, codes=True)
                text = ["".join(x) for x in digits[code.reshape(parts, -1).T].tolist()]
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), row.column(1).flatten(), pa.array(text, pa.string()), pa.array(error.reshape(parts, -1).sum(0))], ["vec_id", "label", "code", "error"])

    out = stored(forest.mapInArrow(coded, schema))
    per_label = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "l")
    if per_label.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        per_label = F.broadcast(per_label)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return out.join(per_label, F.col("label").eqNullSafe(F.col("l"))).drop("l").withColumn("codebooks_sha256", F.lit(digest))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(p.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, label, j, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] AS e FROM k, range(16) r(j))",
        "c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS c, e FROM p QUALIFY c < 64)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, j, p.e, min(({far}, c.c)) AS best FROM p JOIN c{r} c USING (j) GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT j, best[2] AS c, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, len(e) + 1)) AS i FROM (SELECT e FROM p LIMIT 1)) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT j, c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT j, c, coalesce(n.e, o.e) AS e FROM c{r} o LEFT JOIN n{r} n USING (j, c))")
    return "WITH " + ",\n".join(steps) + f""",
o AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best[2]), '' ORDER BY j) AS code, sum(best[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY j, c)) FROM c{ROUNDS}) AS codebooks_sha256 FROM o"""


SQL = _sql()
