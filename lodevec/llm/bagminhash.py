"""BagMinHash signatures: minimum times of hierarchical Poisson processes over discretised weights.

A shingle of weight w is the half-open interval 0..w of the weight axis, which is parted at 0, 1, 2, 4, 8, ... Each part
that w reaches into carries a Poisson process seeded by the shingle and the part, whose rate is the part's length for
each register. A point's place inside its part is found by coin tosses, one for each halving of the part; it counts only
if it lies below w. A register holds the time of its first point. Two multisets agree in a register with a probability
of exactly their weighted Jaccard similarity, sum of smaller weights over sum of larger weights, as the first point of
the larger weights is then one of the smaller.

Points later than a horizon at which nearly all registers are filled are not made at all; where one is still empty the
horizon doubles. All texts of a batch advance together, a point at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodevec.llm.words import U, mix, shingles

REGISTERS, ROWS = 130, 5
GOLDEN = U(0x9E3779B97F4A7C15)


def weighted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles: text, 64-bit hash, weight. doc is in order."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(d)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """docs x registers times, as uint64 bit patterns; every text has a shingle."""
    parts = np.where(weight <= 1, 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1)
    item = np.repeat(np.arange(len(doc)), parts)
    part = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(part > 0, 1 << np.maximum(part - 1, 0), 0)
    long = np.where(part > 0, low, 1)
    who, need = doc[item], weight[item]
    seed = mix(shingle[item] + mix(part.astype(U) + U(77)))
    rate = (long * registers).astype(np.float64)
    total = np.bincount(doc, weight, docs)
    horizon = (np.log(registers) + 3) / np.maximum(total, 1)
    least = np.full(docs * registers, np.inf)
    made = np.zeros(len(item), U)
    time = np.zeros(len(item))
    last = np.zeros(len(item), U)

    def step(i: np.ndarray) -> None:
        made[i] += U(1)
        last[i] = x = mix(seed[i] + made[i] * GOLDEN)
        time[i] -= np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[i]

    active = np.arange(len(item))
    step(active)
    while True:
        waiting = active
        active = active[time[active] <= horizon[who[active]]]
        while len(active):
            y = mix(last[active] ^ U(0xA5A5A5A5A5A5A5A5))
            register = ((y >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            inside = low[active] + (y.astype(np.int64) & (long[active] - 1)) < need[active]
            np.minimum.at(least, (who[active] * registers + register)[inside], time[active][inside])
            step(active)
            active = active[time[active] <= horizon[who[active]]]
        empty = np.isinf(least.reshape(docs, registers)).any(axis=1)
        if not empty.any():
            return least.reshape(docs, registers).view(U)
        horizon[empty] *= 2
        active = waiting[empty[who[waiting]]]


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """docs x bands keys; equal keys of one band mean equal registers, keys of different bands differ."""
    docs, registers = signature.shape
    parts = signature[:, : registers - registers % rows].reshape(docs, -1, rows)
    key = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=U) + U(1)), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U(0xD1342543DE82EF95) + parts[:, :, k])
    return key


def of_texts(texts: pa.Array, registers: int = REGISTERS, rows: int = ROWS, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, number of shingles, and two 64-bit sums that name the multiset of shingles, of each text (no nulls)."""
    doc, hashes = shingles(texts, size)
    d, h, w = weighted(doc, hashes)
    names = np.zeros((len(texts), 2), U)
    first = np.searchsorted(d, np.arange(len(texts)))
    for k, salt in enumerate((U(0x51ED270B), U(0x2545F491))):
        names[:, k] = np.add.reduceat(mix(h + salt) * w.astype(U), first)
    return bands(signatures(d, h, w, len(texts), registers), rows), np.bincount(doc, minlength=len(texts)), names
