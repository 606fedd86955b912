"""SentencePiece encoding for merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table, text_or_empty
from .textops import coded, spread, utf8

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Longer segments get the agenda of their own; shorter ones are merged side by side.
SHORT = 64
NONE = np.int32(2**31 - 1)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Merges:
    """The vocabulary as a table of symbol pairs: (left, right) -> rank of the merged piece by score, and the merged symbol.

    Symbols are the vocabulary's ids, then the characters that occur only inside pieces. A character that occurs in no
    piece is the symbol `other`; it never merges.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        normal = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes = np.zeros(256, np.int32)
        for b in range(256):
            self.bytes[b] = sp.piece_to_id(f"<0x{b:02X}>")
        symbols = dict(normal)
        for c in sorted({c for piece in normal for c in piece} - normal.keys()):
            symbols[c] = size + len(symbols) - len(normal)
        self.size, self.other = size, max([size, *symbols.values()]) + 1
        self.width = self.other + 1
        self.chars = np.full(0x110000, self.other, np.int32)
        self.text = {i: c for c, i in symbols.items() if i >= size}
        for c, i in symbols.items():
            if len(c) == 1:
                self.chars[ord(c)] = i
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        self.pairs = {
            (symbols[piece[:k]], symbols[piece[k:]]): (ranks[sp.get_score(i)], i)
            for piece, i in normal.items()
            for k in range(1, len(piece))
            if piece[:k] in symbols and piece[k:] in symbols
        }
        # Open addressing over 64-bit keys, for look-ups of whole arrays.
        keys = np.array([a * self.width + b for a, b in self.pairs], np.int64)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        for key, slot, (r, m) in zip(keys.tolist(), self._slots(keys).tolist(), self.pairs.values(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.rank[slot], self.merged[slot] = key, r, m

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank (NONE: they don't merge) and merged symbol of each pair."""
        keys = left.astype(np.int64) * self.width + right
        slots = self._slots(keys)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots[open_]]
            open_ = open_[(at != keys[open_]) & (at != -1)]
        return self.rank[slots], self.merged[slots]


def agenda(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges: always the pair of best rank, of those the leftmost."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(*pairs[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in pairs]
    queue = [(r, i, m, p) for r, m, i, p in queue]
    heapq.heapify(queue)
    while queue:
        _, i, merged, (a, b) = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # one of the two has merged meanwhile
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0 and right >= 0 and (p := (symbols[left], symbols[right])) in pairs:
                r, m = pairs[p]
                heapq.heappush(queue, (r, left, m, p))
    return [s for s in symbols if s >= 0]


def agendas(symbols: np.ndarray, segment: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """symbols and segment after all merges, for many short segments: each round takes the first entry of every segment's agenda."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = np.arange(len(symbols))
    rank = np.full(len(symbols), NONE, np.int32)
    merged = np.zeros(len(symbols), np.int32)

    def refresh(at: np.ndarray) -> None:
        inside = at[at + 1 < len(symbols)]
        rank[at] = NONE
        inside = inside[segment[inside] == segment[inside + 1]]
        rank[inside], merged[inside] = merges.find(symbols[inside], symbols[inside + 1])

    refresh(place.copy())
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        best = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(symbols)), starts)
        open_ = (best >> 32) != NONE
        at = (best & 0xFFFFFFFF)[open_]
        symbols[at] = merged[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        over = np.repeat(~open_, np.diff(np.append(starts, len(symbols))))
        if over.any():
            done.append((place[over], symbols[over], segment[over]))
            stay &= ~over
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        symbols, segment, place, rank, merged, changed = (x[stay] for x in (symbols, segment, place, rank, merged, changed))
        at = np.flatnonzero(changed)
        left = at[at > 0] - 1
        refresh(np.concatenate((at, left)))
    if not done:
        return symbols, segment
    place, symbols, segment = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(place, kind="stable")
    return symbols[order], segment[order]


class Encoder:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.library = self.merges.library

    def segments(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after the other, and how many each has."""
        m = self.merges
        raw, bounds = utf8(distinct.cast(pa.large_string()))
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.cumsum((raw & 0xC0) != 0x80)  # characters up to each byte
        begins = np.concatenate(([0], first))[bounds]
        lengths = np.diff(begins)
        segment = np.repeat(np.arange(len(lengths)), lengths)
        symbols = m.chars[points]
        # `other` keeps its character as a negative number.
        symbols = np.where(symbols == m.other, -1 - points.astype(np.int64), symbols)
        long_ = np.flatnonzero(lengths > SHORT)
        short = np.repeat(lengths <= SHORT, lengths)
        out, of = agendas(np.where(symbols[short] < 0, m.other, symbols[short]).astype(np.int32), segment[short], m)
        unknown = symbols[short][symbols[short] < 0]  # in order, as merges never touch them
        out = out.astype(np.int64)
        out[out == m.other] = unknown
        parts, owners = [out], [of]
        for s in long_.tolist():
            mine = symbols[begins[s] : begins[s + 1]]
            kept = mine[mine < 0]
            got = np.array(agenda(np.where(mine < 0, m.other, mine).tolist(), m.pairs), np.int64)
            got[got == m.other] = kept
            parts.append(got)
            owners.append(np.full(len(got), s))
        out, of = np.concatenate(parts), np.concatenate(owners)
        if len(long_):
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
        odd = np.flatnonzero((out < 0) | (out >= m.size))
        if len(odd):
            names = [chr(-1 - x) if x < 0 else m.text[x] for x in out[odd].tolist()]
            spelled = [m.bytes[list(c.encode())] for c in names]
            n = np.ones(len(out), np.int64)
            n[odd] = [len(x) for x in spelled]
            begin = np.cumsum(n) - n
            whole = np.repeat(out, n)
            for b, x in zip(begin[odd].tolist(), spelled, strict=True):
                whole[b : b + len(x)] = x
            out, of = whole, np.repeat(of, n)
        return out.astype("<u4"), np.bincount(of, minlength=len(lengths))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with begin and end, one after the other, and how many each has.

        No piece has a space after another character, so a text's pieces are those of its segments: a run of spaces and
        the characters up to the next one. Equal segments of the batch are merged once.
        """
        shown = pc.replace_substring(texts.cast(pa.large_string()), " ", SPACE)
        big = lambda x: pa.scalar(x, pa.large_string())
        shown = pc.if_else(pc.equal(pc.binary_length(shown), 0), big(""), pc.binary_join_element_wise(big(SPACE), shown, big("")))
        raw, bounds = utf8(shown)
        mark = np.zeros(len(raw) + 3, bool)  # where a space begins, shifted by 3
        mark[3:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81) if len(raw) > 2 else False
        first = mark[3:] & ~mark[:-3] if len(raw) else np.zeros(0, bool)
        begin = np.zeros(len(raw) + 1, bool)
        begin[:-1] = first
        begin[bounds] = True
        starts = np.flatnonzero(begin[:-1])
        w = coded(raw, starts, np.append(starts[1:], len(raw)), bounds)
        ids, lengths = self.segments(w.distinct)
        at, n = spread(w.codes, np.cumsum(lengths) - lengths, lengths)
        per_text = np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], w.ends))]) + 2
        flat = np.empty(int(per_text.sum()), "<u4")
        ends = np.cumsum(per_text)
        edge = np.zeros(len(flat), bool)
        edge[ends - 1] = True
        edge[ends - per_text] = True
        flat[~edge] = ids[at]
        flat[ends - per_text], flat[ends - 1] = self.library.bos_id(), self.library.eos_id()
        return flat, per_text


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, check: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    ids are those of the sentencepiece library with begin and end ids: merging takes the adjacent pair whose piece has
    the best score, of equal ones the leftmost, and spells characters outside the vocabulary in bytes. The text is
    decoded from the ids again. ids: also return them. check: also encode every Arrow batch with the library, and fail
    on the first difference. Null text is empty: begin and end only. Null and repeated ids have rows of their own. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in steps(batches, most=8 << 20):
            flat, n = encoder(batch.column(1))
            ends = np.cumsum(n)
            lists = [flat[b - k : b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
            decoded = encoder.library.decode([x.tolist() for x in lists])
            if check:
                own = [encoder.library.encode(t, add_bos=True, add_eos=True) for t in batch.column(1).to_pylist()]
                if any(a.tolist() != b for a, b in zip(lists, own, strict=True)):
                    raise ValueError("ids differ from the library's")
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(n.astype(np.int64)),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in lists]),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
            }
            if ids:
                columns |= {"ids": pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_path(), check=True)
