"""Token ids in seekable zstandard files: one frame per document, and a seek table with checksums at the end."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .common import shared_dir, steps, stored, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: A file is closed once it has so many compressed bytes or documents.
FILE_BYTES, FILE_DOCS = 64 << 20, 1_000_000
#: Frames that lie this close are read in one go, up to READ_BYTES at a time.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Most pieces of text whose ids a Python worker remembers from one batch to the next.
REMEMBERED = 500_000
#: Prefix sums over parts of the corpus are taken within blocks of so many parts, and over the blocks.
PARTS_A_BLOCK = 1000

# Fixed values of the public zstandard format and its seekable variant: magic numbers, and the seek table's layout.
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80
_SKIP, _ENTRY, _FOOTER, _HEAD = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<4sBBI")
INDEX_NAME, VERSION = b"tok1", 1


def checksum(data: bytes) -> int:
    """The low 32 bits of XXH64, as seek tables have them."""
    import xxhash

    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


class Writer:
    """A file of documents: a frame each, then an index frame of ids and lengths that decoders skip, then the seek table."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.entries = out, width, []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.codec = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.size = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        raw = tokens.astype(f"<u{self.width}").tobytes()
        frame = self.codec.compress(raw)
        self._put(frame)
        self.entries.append((len(frame), len(raw), checksum(raw)))
        self.ids.append(doc_id)
        self.lengths.append(len(tokens))

    def close(self) -> None:
        n = len(self.ids)
        absent = np.array([i is None for i in self.ids], np.uint8)
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + absent.tobytes() + np.array(self.lengths, "<i8").tobytes()
        index = _HEAD.pack(INDEX_NAME, VERSION, self.width, n) + struct.pack("<I", checksum(index)) + self.codec.compress(index)
        self._put(_SKIP.pack(INDEX_MAGIC, len(index)) + index)
        self.entries.append((_SKIP.size + len(index), 0, checksum(b"")))
        rows = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self._put(_SKIP.pack(TABLE_MAGIC, len(rows)) + rows)
        self.out.close()


class Reader:
    """Random access to the documents of a file. Opening reads the seek table and the index; `read` only the frames asked for."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.codec = source, zstandard.ZstdDecompressor()
        count, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.entries = np.frombuffer(self._at(size - _FOOTER.size - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries[:, 0])))
        if self.offsets[-1] + _SKIP.size + 12 * count + _FOOTER.size != size or tuple(self.entries[-1, 1:]) != (0, checksum(b"")):
            raise ValueError("the seek table of the file is damaged")
        head = self._at(int(self.offsets[count - 1]), int(self.entries[count - 1, 0]))[_SKIP.size :]
        name, version, self.width, n = _HEAD.unpack_from(head)
        index = self.codec.decompress(head[_HEAD.size + 4 :])
        if name != INDEX_NAME or version != VERSION or n != count - 1 or struct.unpack_from("<I", head, _HEAD.size)[0] != checksum(index):
            raise ValueError("the index of the file is damaged")
        absent = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(index, "<i8", n), mask=absent)
        self.lengths = np.frombuffer(index, "<i8", n, 9 * n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.decompressed = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def read(self, numbers: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of the documents with these ascending numbers in the file."""
        group: list[int] = []
        for i in numbers:
            if group and (self.offsets[i] - self.offsets[group[-1] + 1] > GAP_BYTES or self.offsets[i + 1] - self.offsets[group[0]] > READ_BYTES):
                yield from self._group(group)
                group = []
            group.append(int(i))
        if group:
            yield from self._group(group)

    def _group(self, group: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        first = int(self.offsets[group[0]])
        data = memoryview(self._at(first, int(self.offsets[group[-1] + 1]) - first))
        for i in group:
            a, b = int(self.offsets[i]) - first, int(self.offsets[i + 1]) - first
            raw = self.codec.decompress(data[a:b], max_output_size=int(self.entries[i, 1])) if self.entries[i, 1] else b""
            self.decompressed += 1
            if len(raw) != self.entries[i, 1] or checksum(raw) != self.entries[i, 2]:
                raise ValueError(f"document {i} of the file does not have the checksum of its seek table")
            yield i, np.frombuffer(raw, f"<u{self.width}")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: Last characters of white space beyond ASCII, as UTF-8: a cut after one of them isn't safe.
_WIDE_WHITE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def cuts(raw: np.ndarray, bounds: np.ndarray, punctuation: bool = True) -> np.ndarray:
    """Where the pieces of all texts start: at texts' starts, before ASCII white space that follows anything else than
    white space, and with `punctuation` between an ASCII or Latin-1 letter and ASCII punctuation other than an apostrophe.

    The tokenizer splits a text there whatever comes before and after, so a text's ids are those of its pieces.
    """
    start = np.zeros(len(raw), bool)
    if not len(raw):
        return np.flatnonzero(start)
    white = textops.WHITE[raw]
    start[1:] = white[1:] & ~white[:-1]
    wide = np.flatnonzero(start)
    wide = wide[raw[wide - 1] >= 0x80]
    for mark in _WIDE_WHITE:
        hit = wide[wide >= len(mark)]
        for i, byte in enumerate(reversed(mark), 1):
            hit = hit[raw[hit - i] == byte]
        start[hit] = False
    if punctuation:
        letter_ends, letter_starts = textops.letters(raw)
        mark = textops.EDGE[raw] == 2
        start[1:] |= (letter_ends[:-1] & mark[1:]) | (mark[:-1] & letter_starts[1:])
    start[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(start)


class PieceIds:
    """Ids of texts by the tokenizers library, which is asked once for a piece of a batch, or of the one before it.

    Pieces of one space and a word are encoded many at a time: each of their ids that starts with a space starts a piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True
        self.known, self.ids, self.lengths = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _encoded(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, lengths = [np.zeros(0, "<u4")], []
        for at in range(0, len(names), 20_000):
            for e in self.library.encode_batch_fast(names[at : at + 20_000], add_special_tokens=False):
                parts.append(np.array(e.ids, "<u4"))
                lengths.append(len(parts[-1]))
        return np.concatenate(parts), np.array(lengths, np.int64)

    def _spaced(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = self._encoded(["".join(names[at : at + 500]) for at in range(0, len(names), 500)])
        starts = np.flatnonzero(self.spaced[flat])
        if len(starts) != len(names) or (len(flat) and not self.spaced[flat[0]]):
            return self._encoded(names)
        return flat, np.diff(starts, append=len(flat))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        raw, bounds = textops.utf8(texts)
        # Where the string of a special token may occur, it must stay whole.
        starts = cuts(raw, bounds, punctuation=not pc.any(pc.match_substring(texts, "<|")).as_py())
        w = textops.coded(raw, starts, np.append(starts[1:], len(raw))[: len(starts)], bounds)
        names = w.distinct.cast(pa.large_string())
        place = pc.fill_null(pc.index_in(names, self.known), -1).to_numpy().astype(np.int64)
        single = pc.match_substring_regex(names, r"^ (?:[a-zA-ZÀ-ÖØ-öø-ÿ]+|[!-;=-~]+)$").to_numpy(zero_copy_only=False)
        pools, sizes, known = [self.ids], [self.lengths], len(self.known)
        for new, encode in ((np.flatnonzero((place < 0) & single), self._spaced), (np.flatnonzero((place < 0) & ~single), self._encoded)):
            ids, n = encode(names.take(pa.array(new)).to_pylist())
            pools.append(ids)
            sizes.append(n)
            place[new] = np.arange(known, known + len(new))
            known += len(new)
        pool, sizes = np.concatenate(pools), np.concatenate(sizes)
        first, lengths = (np.cumsum(sizes) - sizes)[place], sizes[place]
        at, n = textops.spread(w.codes, first, lengths)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], w.ends))]
        keep = np.flatnonzero(np.bincount(w.codes, minlength=len(names)) > 1)[:REMEMBERED]
        self.known, self.lengths = names.take(pa.array(keep)), lengths[keep]
        self.ids = pool[textops.spread(keep, first, lengths)[0]]
        return pool[at], np.diff(ends)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all rows, each ended by `end_id`, in ascending order of ids; the manifest: file, part, seq, n_docs, n_tokens, bytes.

    folder: a URI that all executors see and pyarrow's file systems know. Rows are dealt by ranges of ids; those of equal
    ids, of which there may be many, are dealt on by a hash of the text and by position. Every task writes its range to
    files of about `file_bytes`. Files have new names in every attempt and the manifest lists those of the attempt that
    counts, so a lost executor costs its tasks only, and what it left is never read.

    Null text is empty: its only token is the end id. Null ids come first and stay null. Repeated ids are documents of
    their own, in the order of their texts' hashes. No rows give no files. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = PieceIds(path)
        width = 2 if max(ids_of.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4")
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        part, seq, writer, name = TaskContext.get().partitionId(), 0, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            row = {"file": name, "part": part, "seq": seq, "n_docs": len(writer.ids), "n_tokens": sum(writer.lengths), "bytes": writer.size}
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in steps(batches, most=8 << 20):
            flat, n = ids_of(batch.column(1))
            ends = np.cumsum(n)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True):
                if writer is None:
                    name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok.zst"
                    writer = Writer(fs.open_output_stream(f"{top}/{name}", compression=None), width)
                writer.add(doc_id, np.concatenate((flat[a:b], end)))
                if writer.size >= file_bytes or len(writer.ids) >= FILE_DOCS:
                    yield closed()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("at")]
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(dealt.mapInArrow(run, "file string, part int, seq int, n_docs long, n_tokens long, bytes long"))


def _before(manifest: DataFrame) -> DataFrame:
    """The manifest with start: the tokens of all files before, by prefix sums in steps, so that no task holds all files."""
    block = F.floor(F.col("part") / PARTS_A_BLOCK).alias("block")
    parts = manifest.groupBy(block, "part").agg(F.sum("n_tokens").alias("n"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("a"))
    parts = parts.select("block", "part", (F.sum("n").over(Window.partitionBy("block").orderBy("part")) - F.col("n")).alias("b"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("c", inside).join(parts, "part").join(blocks, "block").withColumn("start", F.col("a") + F.col("b") + F.col("c")).drop("a", "b", "c", "block")


def _opened(folder: str, name: str) -> Reader:
    fs, top = pyarrow.fs.FileSystem.from_uri(folder)
    source = fs.open_input_file(f"{top}/{name}")
    return Reader(source, source.size())


def contents(manifest: DataFrame, folder: str, tokens: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (tokens of all documents before it), n_tokens, file, number; with `tokens` also ids_crc32.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers, read from the document's frame. Without it,
    only seek tables and indexes are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = _opened(folder, name)
                for at in range(0, len(reader.lengths), 10_000):
                    numbers = np.arange(at, min(at + 10_000, len(reader.lengths)))
                    columns = [reader.doc_ids.slice(at, len(numbers)), pa.array(reader.starts[numbers] + start), pa.array(reader.lengths[numbers]), pa.array([name] * len(numbers)), pa.array(numbers)]
                    names = ["doc_id", "start", "n_tokens", "file", "number"]
                    if tokens:
                        crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.read(numbers)]
                        columns, names = [*columns, pa.array(crc, pa.int64())], [*names, "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    files = _before(manifest).select("file", "start")
    return files.repartition(max(1, min(50_000, manifest.count()))).mapInArrow(run, "doc_id long, start long, n_tokens long, file string, number long" + ", ids_crc32 long" * tokens)


def fetch(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids (array of int) of the documents whose id is in the first column of `wanted`; only their frames are decompressed.

    Null ids are never found, repeated wanted ids count once, and repeated document ids are all found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            names, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(names):
                to = at + 1
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if names[at] != name:
                    name, reader = names[at], _opened(folder, names[at])
                for i, ids in reader.read(numbers[at:to]):
                    yield pa.RecordBatch.from_arrays([reader.doc_ids.slice(i, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])
                at = to

    ids = wanted.select(F.col(wanted.columns[0]).cast("long").alias("doc_id")).distinct()
    places = contents(manifest, folder, tokens=False).join(ids, "doc_id", "left_semi").select("file", "number")
    return places.repartition("file").sortWithinPartitions("file", "number").mapInArrow(run, "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    manifest = write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return contents(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
