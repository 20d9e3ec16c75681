"""Words and word shingles of whole batches of texts, as arrays of hashes.

A word is a run of ASCII letters and digits and of any characters beyond ASCII, lower-cased. Its hash adds up a random
number for each byte and place (tabulation; a polynomial modulo 2^64 has pairs of words that share a hash whatever its base
is), mixes that, and adds up what the pieces of PIECE bytes give; a shingle's is one of its words' hashes in order.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0xD1342543DE82EF95)
#: Bytes handled at once; longer texts are handled alone. Places of a word that have random numbers of their own.
BATCH, PIECE = 1 << 20, 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is part of words; the number of each byte (column) at each place (row)."""
    part_of_word = np.zeros(256, bool)
    part_of_word[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        part_of_word[a:b] = True
    return part_of_word, mix(mix(np.arange(1, 256 * PIECE + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + BASE)


def slices(texts: pa.Array, size: int = BATCH):
    """(first row, array) so that each array has about size bytes or one row."""
    long = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    sums, at = np.cumsum(long), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + size, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (no nulls), and where each text begins, and the end."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


class Words(NamedTuple):
    """hashes, begin, end: of each word, its hash, first byte and end byte; first: for each text and the end, its first
    word; data: the bytes; sums: running sums of the bytes' numbers, so that the first PIECE bytes of a word from b on add up
    to sums[b + n] - sums[b]."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    sums: np.ndarray


def words(texts: pa.Array, lower: bool = True) -> Words:
    data, edges = raw_bytes(pc.utf8_lower(texts) if lower else texts)
    part, numbers = _tables()
    inside = part[data]
    before = np.concatenate([[False], inside[:-1]])
    starts = edges[:-1][edges[:-1] < edges[1:]]
    before[starts] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[starts[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    # From a word's beginning to the next one's, places count up; what lies between words is added up but never used.
    place = np.arange(len(data), dtype=np.int64)
    if len(begin):
        place[begin[0] :] -= np.repeat(begin, np.diff(np.append(begin, len(data))))
    sums = np.concatenate([[U(0)], np.cumsum(numbers[(place % PIECE) << 8 | data])])
    hashes = mix(sums[end] - sums[begin])
    long = np.flatnonzero(end - begin > PIECE)
    if len(long):
        many = -(-(end - begin)[long] // PIECE)
        at = np.cumsum(many) - many
        nth = np.arange(many.sum()) - np.repeat(at, many)
        from_ = np.repeat(begin[long], many) + nth * PIECE
        to = np.minimum(from_ + PIECE, np.repeat(end[long], many))
        hashes[long] = mix(np.add.reduceat(mix(sums[to] - sums[from_] + (nth.astype(U) + U(1)) * BASE), at))
    return Words(hashes, begin, end, np.searchsorted(begin, edges), data, sums)


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of size words, in order. A text with fewer words is one shingle of all of them."""
    found = words(texts)
    hashes, first = found.hashes, found.first
    count = np.diff(first)
    at = np.flatnonzero(np.arange(len(hashes)) + size <= np.repeat(first[1:], count))
    long = np.zeros(len(at), U)
    for k in range(size):
        long = mix(long * BASE + hashes[at + k])
    doc = np.repeat(np.arange(len(count)), np.maximum(count - size + 1, 0))
    few = np.flatnonzero(count < size)
    short = np.full(len(few), U(0x1234567), U)
    for k in range(size - 1):
        has = count[few] > k
        short[has] = mix(short[has] * BASE + hashes[first[few[has]] + k])
    docs = np.concatenate([doc, few])
    order = np.argsort(docs, kind="stable")
    return docs[order], np.concatenate([long, short])[order]
