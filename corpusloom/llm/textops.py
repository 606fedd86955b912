"""Words of an Arrow column of texts as codes into a dictionary, found on the UTF-8 bytes without a Python loop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space; these bytes never occur inside a longer UTF-8 sequence.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    codes: np.ndarray  #: of each word, in order
    per_text: np.ndarray  #: number of words of each text
    distinct: pa.BinaryArray  #: the word of each code
    starts: np.ndarray  #: byte at which each word starts
    stops: np.ndarray  #: byte after each word's last one

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.per_text)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), and where each text starts, with the end of the last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def coded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> Words:
    """The pieces raw[starts[i]:ends[i]]; bounds: where the texts start."""
    lengths = ends - starts
    total = int(lengths.sum())
    if total == len(raw):
        packed = raw
    else:
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        packed = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    found = pieces.dictionary_encode()
    per_text = np.diff(np.searchsorted(starts, bounds))
    return Words(found.indices.to_numpy(zero_copy_only=False), per_text, found.dictionary, starts, ends)


#: What a byte is at the edge of a word: 1 an ASCII letter, 2 ASCII punctuation other than an apostrophe.
EDGE = np.zeros(256, np.uint8)
EDGE[[*range(65, 91), *range(97, 123)]] = 1
EDGE[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2


def letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an ASCII or Latin-1 letter ends, and where one starts."""
    ends, starts = EDGE[raw] == 1, EDGE[raw] == 1
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    ends[lead + 1] = True
    starts[lead] = True
    return ends, starts


def words(texts: pa.Array, lower: bool = False, punctuation: bool = False) -> Words:
    """Runs of characters that aren't ASCII white space; lower: A-Z become a-z first; punctuation: cut between a letter and ASCII punctuation."""
    raw, bounds = utf8(texts)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    solid = ~WHITE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    before = np.concatenate(([False], solid[:-1])) if len(raw) else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(raw) else solid
    if punctuation and len(raw):
        letter_ends, letter_starts = letters(raw)
        mark = EDGE[raw] == 2
        cut = np.flatnonzero((letter_ends[:-1] & mark[1:]) | (mark[:-1] & letter_starts[1:])) + 1
        first[cut] = True
        starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return coded(raw, starts, ends, bounds)


def spread(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of each code's list, one list after the other, and the lengths of the lists."""
    n = lengths[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts[codes] - (ends - n), n)
    return at, n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x
