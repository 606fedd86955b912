"""Mixture-controlled packing of token ids into fixed windows."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .common import small_steps, stored, table

WINDOW = 2048
#: Tokens that one task packs. A lane is a group of documents chosen by a hash of their ids, so it has a share of every source.
LANE_TOKENS = 2_000_000
#: Prefix sums over lanes are taken within blocks of so many lanes, and over the blocks.
LANES_A_BLOCK = 1000
#: A queue gives at least so many tokens at a time, or the rest of its document.
GRAIN = 256
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Most words whose ids a Python worker remembers from one batch to the next.
REMEMBERED = 500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordIds:
    """Ids of words by the tokenizers library, which is asked once for a word of a batch, or of the one before it.

    This tokenizer lower-cases, drops white space and joins characters neither across it nor across the border of
    letters and punctuation, so a text's ids are those of its pieces. Where the strings of special tokens may occur,
    words stay whole. Words of Latin-1 letters are encoded many at a time, as the last id of a word is one that ends
    words; the others one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known, self.ids, self.lengths = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _encoded(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all names, and how many each has."""
        parts, lengths = [np.zeros(0, "<u4")], []
        for at in range(0, len(names), 20_000):
            for e in self.library.encode_batch_fast(names[at : at + 20_000], add_special_tokens=False):
                parts.append(np.array(e.ids, "<u4"))
                lengths.append(len(parts[-1]))
        return np.concatenate(parts), np.array(lengths, np.int64)

    def _letters(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = self._encoded([" ".join(names[at : at + 500]) for at in range(0, len(names), 500)])
        ends = np.flatnonzero(self.last[flat])
        if len(ends) != len(names):
            return self._encoded(names)
        return flat, np.diff(ends, prepend=-1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        plain = not pc.any(pc.match_substring(texts, "<|")).as_py()
        w = textops.words(texts, lower=plain, punctuation=plain)
        names = w.distinct.cast(pa.large_string())
        place = pc.fill_null(pc.index_in(names, self.known), -1).to_numpy().astype(np.int64)
        letters = pc.match_substring_regex(names, "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        # The pool holds the ids of known words, then of new words of letters, then of other new words.
        pools, sizes, known = [self.ids], [self.lengths], len(self.known)
        for new, encode in ((np.flatnonzero((place < 0) & letters), self._letters), (np.flatnonzero((place < 0) & ~letters), self._encoded)):
            ids, n = encode(names.take(pa.array(new)).to_pylist())
            pools.append(ids)
            sizes.append(n)
            place[new] = np.arange(known, known + len(new))
            known += len(new)
        pool, sizes = np.concatenate(pools), np.concatenate(sizes)
        starts, lengths = (np.cumsum(sizes) - sizes)[place], sizes[place]
        at, n = textops.spread(w.codes, starts, lengths)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], w.ends))]
        # Remembered for the next batch: what occurs twice in this one.
        keep = np.flatnonzero(np.bincount(w.codes, minlength=len(names)) > 1)[:REMEMBERED]
        self.known, self.lengths = names.take(pa.array(keep)), lengths[keep]
        self.ids = pool[textops.spread(keep, starts, lengths)[0]]
        return pool[at], np.diff(ends)


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = END_ID) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit) of every row; the last id is `end_id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_steps(batches, most=6 << 20):
            flat, n = ids_of(batch.column(2))
            ends = np.cumsum(n)
            rows = [flat[b - k : b].tobytes() + end for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n + 1), pa.array(rows, pa.binary())], ["doc_id", "source", "n_tokens", "ids"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")


def round_robin(lengths: np.ndarray, queue: np.ndarray, share: np.ndarray, deficit: np.ndarray, position: int, window: int, grain: int) -> list[tuple[int, int, int, int]]:
    """(document, start, length, position) of the pieces in order.

    Documents are numbered in the order in which their queues hold them; queue: of each document. Every window adds its
    size times each open queue's share to the deficits. Queues are then visited in turn, and give what their deficit
    allows if that is at least `grain` tokens or the rest of a document; when none can, the queue with the largest
    deficit gives. What a window doesn't give stays in the deficits. position: where the first piece starts in the
    stream of all lanes; a piece ends at a multiple of `window` at the latest.
    """
    k = len(share)
    members = [np.flatnonzero(queue == q).tolist()[::-1] for q in range(k)]
    left = [[int(lengths[members[q][-1]]), 0] if members[q] else [0, 0] for q in range(k)]  # of the head: tokens left, tokens given
    owed = [float(x) for x in deficit]
    live = [q for q in range(k) if members[q]]
    pieces: list[tuple[int, int, int, int]] = []
    room, turn = window - position % window, 0
    total = sum(share[q] for q in live)
    for q in live:
        owed[q] += room * share[q] / total

    def give(q: int, n: int) -> None:
        nonlocal position, room
        doc, (rest, start) = members[q][-1], left[q]
        pieces.append((doc, start, n, position))
        position, room, owed[q] = position + n, room - n, owed[q] - n
        if n < rest:
            left[q] = [rest - n, start + n]
            return
        members[q].pop()
        if members[q]:
            left[q] = [int(lengths[members[q][-1]]), 0]
        else:
            live.remove(q)

    while live:
        idle = 0
        while room and live and idle < len(live):
            q = live[turn % len(live)]
            n = min(int(owed[q]), left[q][0], room)
            if n > 0 and (n >= grain or n == left[q][0] or n == room):
                give(q, n)
                idle = 0
                turn += 0 if owed[q] >= grain and q in live else 1
            else:
                idle, turn = idle + 1, turn + 1
        if room and live:
            q = max(live, key=owed.__getitem__)
            give(q, min(max(grain, int(owed[q])), left[q][0], room))
        if not room and live:
            room = window
            total = sum(share[q] for q in live)
            for q in live:
                owed[q] += window * share[q] / total
    return pieces


def pack(
    docs: DataFrame,
    path: str,
    targets: dict[str, float] | None = None,
    window: int = WINDOW,
    grain: int = GRAIN,
    lane_tokens: int = LANE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    All pieces form one stream, cut into sequences of `window` tokens; only the last sequence may be shorter. Documents
    are dealt to lanes of about `lane_tokens` tokens by a hash of their rows, whatever their sources, and each lane is
    packed by `round_robin` in one task. Where a lane starts in the stream, and which deficits it inherits from the lanes
    before it, follow from the token sums per lane and source, so the lanes run at the same time and yet carry on from
    one another. targets: the wanted share of each source's tokens (others: 0, taken last); by default, a source's share
    of all tokens, so that all queues end together. The token ids are stored once and shuffled once.

    Null text is empty: its only token is the end id. Null source is a queue of its own. Null and repeated ids give
    documents of their own. No rows give no pieces. Other columns are ignored.
    """
    tokens = stored(token_table(docs, path, id_col, text_col, source_col))
    lanes = max(1, -(-int(tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]) // lane_tokens))
    lane = F.pmod(F.xxhash64("doc_id", "n_tokens", "source"), F.lit(lanes)).cast("int").alias("lane")
    sums = stored(tokens.groupBy(lane, "source").agg(F.sum("n_tokens").alias("n")))
    # Prefix sums over lanes in two steps, so that no task holds all lanes of a large corpus.
    per_lane = sums.groupBy("lane").agg(F.sum("n").alias("lane_n")).withColumn("block", F.floor(F.col("lane") / LANES_A_BLOCK))
    blocks = per_lane.groupBy("block").agg(F.sum("lane_n").alias("block_n"))
    blocks = blocks.select("block", (F.sum("block_n").over(Window.orderBy("block")) - F.col("block_n")).alias("block_start"))
    inside = F.sum("lane_n").over(Window.partitionBy("block").orderBy("lane")) - F.col("lane_n")
    starts = per_lane.withColumn("inside", inside).join(blocks, "block").select("lane", (F.col("block_start") + F.col("inside")).alias("lane_start"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("source_n"))
    total = sums.agg(F.sum("n").alias("n")).select("n").scalar()
    if targets is None:
        share = F.col("source_n") / total
    else:
        share = F.coalesce(F.element_at(F.lit(targets), F.col("source")), F.lit(0.0)) / sum(targets.values())
    # Likewise per source: blocks of lanes first, so that a source's lanes don't meet in one task.
    own = sums.withColumn("block", F.floor(F.col("lane") / LANES_A_BLOCK))
    own_blocks = own.groupBy("source", "block").agg(F.sum("n").alias("block_n"))
    own_blocks = own_blocks.select(
        "source", "block", (F.sum("block_n").over(Window.partitionBy("source").orderBy("block")) - F.col("block_n")).alias("before")
    )
    inside = F.sum("n").over(Window.partitionBy("source", "block").orderBy("lane")) - F.col("n")
    state = (
        own.withColumn("inside", inside)
        .join(own_blocks, ["source", "block"])
        .withColumn("given", F.col("before") + F.col("inside"))
        .join(by_source, "source")
        .join(starts, "lane")
        .select("lane", "source", "lane_start", share.alias("share"), (share * F.col("lane_start") - F.col("given")).alias("deficit"))
    )

    def run(key: tuple, rows: pd.DataFrame, queues: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens"], kind="stable", na_position="first").reset_index(drop=True)
        queues = queues.sort_values("source").reset_index(drop=True)
        number = {s: i for i, s in enumerate(queues["source"])}
        shares = np.maximum(queues["share"].to_numpy(float), 1e-12)
        got = round_robin(
            rows["n_tokens"].to_numpy(), rows["source"].map(number).to_numpy(), shares, queues["deficit"].to_numpy(float), int(queues["lane_start"].iloc[0]), window, grain
        )
        got = pd.DataFrame(got, columns=["d", "start", "length", "position"])
        ids = rows["ids"].tolist()
        out = rows.loc[got["d"], ["doc_id", "source", "n_tokens"]].reset_index(drop=True).rename(columns={"n_tokens": "doc_tokens"})
        out["start"], out["length"] = got["start"], got["length"]
        out["ids_crc32"] = [zlib.crc32(memoryview(ids[d])[4 * a : 4 * (a + n)]) for d, a, n in zip(got["d"], got["start"], got["length"], strict=True)]
        out["sequence_id"], out["offset"] = got["position"] // window, got["position"] % window
        return out

    packed = tokens.withColumn("lane", lane).groupBy("lane").cogroup(state.groupBy("lane"))
    return packed.applyInPandas(run, "doc_id long, source string, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
