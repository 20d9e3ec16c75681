"""Kernels on blocks of vectors: Arrow columns as matrices, distances, best candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Rows x dimension in double precision. Null vectors are rows of NaN; any other length is an error."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.full((len(vectors), dimension), np.nan)
    has = np.asarray(vectors.is_valid())
    flat = np.asarray(vectors.drop_null().flatten().to_numpy(zero_copy_only=False), np.float64)
    if len(flat) != has.sum() * dimension or (np.diff(np.asarray(vectors.drop_null().offsets)) != dimension).any():
        raise ValueError(f"a vector is not of dimension {dimension}")
    out[has] = flat.reshape(-1, dimension)
    return out


def lists(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    n, d = rows.shape
    flat = pa.array(rows.ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), flat)


def unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


#: Numbers in a block of distances at once.
CELLS = 1 << 21


def distances(x: np.ndarray, c: np.ndarray, block: int = CELLS) -> np.ndarray:
    """Squared distances of rows of x to rows of c, by differences (exact for equal rows), in blocks of memory."""
    out = np.empty((len(x), len(c)))
    step = max(1, block // max(1, c.size))
    for at in range(0, len(x), step):
        d = x[at : at + step, None, :] - c[None]
        out[at : at + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def near_distances(q: np.ndarray, x: np.ndarray, k: int, worst: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of rows of q to those rows of x that may be among the k nearest (to 9 places), infinite for the
    others. worst: for each row of q, the distance beyond which none counts.

    A product of matrices finds the candidates; only those within its rounding error of the kth are measured by
    differences.
    """
    qn, xn = (q * q).sum(axis=1), (x * x).sum(axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        rough = q @ x.T
        rough *= -2.0
        rough += qn[:, None]
        rough += xn
    np.nan_to_num(rough, copy=False, nan=np.inf, posinf=np.inf)
    finite = xn[np.isfinite(xn)]
    slack = 2e-13 * (qn + (finite.max() if len(finite) else 0.0)) + 2e-9
    cut = np.full(len(q), np.inf) if worst is None else worst.copy()
    if len(x) > k:
        cut = np.minimum(cut, np.partition(rough, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((rough <= (cut + slack)[:, None]) & (rough < np.inf))
    rough.fill(np.inf)
    step = max(1, CELLS // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        d = q[a] - x[b]
        rough[a, b] = np.einsum("ij,ij->i", d, d)
    return rough


#: Queries and rows whose distances offer() makes at once: 1 MB in single precision, which a core's cache holds.
ASKED, OFFERED = 128, 2048


def offer(best: Best, q: np.ndarray, x: np.ndarray, key: np.ndarray) -> None:
    """Offers all rows of x to all queries of best, whose vectors are q, as near_distances() and add() do, for many of both.

    The product of matrices that finds candidates is in single precision where norms allow. Its rounding error is at most
    the dimension (and a few operations) times the unit of rounding times the sizes of what is added up, and all that are so
    near to the kth found so far are measured by differences in double precision.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        qn, xn = (q * q).sum(axis=1), (x * x).sum(axis=1)
    sound = np.isfinite(xn)
    x, xn, key = x[sound], xn[sound], key[sound]
    top = max(qn[np.isfinite(qn)].max(initial=0.0), xn.max(initial=0.0))
    kind = np.float32 if top < 1e30 else np.float64
    unit_ = (q.shape[1] + 8) * float(np.finfo(kind).eps)
    turned = (-2.0 * q).astype(kind)
    for at in range(0, len(x), OFFERED):
        some, n = x[at : at + OFFERED], xn[at : at + OFFERED]
        columns, norms = np.ascontiguousarray(some.T.astype(kind)), n.astype(kind)
        most = n.max(initial=0.0)
        for a in range(0, len(q), ASKED):
            to = min(a + ASKED, len(q))
            with np.errstate(invalid="ignore", over="ignore"):
                rough = turned[a:to] @ columns
                rough += norms
                slack = unit_ * (most + 2.0 * np.sqrt(qn[a:to] * most)) + 2e-9
                cut = best.distance[a:to, -1] - qn[a:to] + slack + unit_ * qn[a:to]
            fresh = ~np.isfinite(best.distance[a:to, -1])
            if fresh.any() and len(some) > best.k:  # no kth yet: that of this block
                with np.errstate(invalid="ignore"):
                    cut[fresh] = np.partition(rough[fresh], best.k - 1, axis=1)[:, best.k - 1] + 2 * slack[fresh]
            elif fresh.any():
                cut[fresh] = np.inf
            cut[~np.isfinite(qn[a:to])] = -np.inf
            near = np.flatnonzero(rough <= np.nextafter(cut.astype(kind), kind(np.inf))[:, None])
            if len(near):
                i, j = np.divmod(near, len(some))
                d = np.concatenate([_apart(q[a + i[b : b + OFFERED]], some[j[b : b + OFFERED]]) for b in range(0, len(i), OFFERED)])
                there = np.isfinite(d)
                best.put(a + i[there], d[there], key[at + j[there]])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


#: Numbers in a block of nearest(), which passes over each several times: as many as a core's cache holds.
TILE = 1 << 16


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest row of c; of equally near ones (to 9 places) the first. In blocks of
    rows, so memory does not grow with both."""
    step = max(32, TILE // max(1, len(c)))
    index, exact = np.zeros(len(x), np.int64), np.zeros(len(x))
    with np.errstate(invalid="ignore", over="ignore"):
        norms, size = (c * c).sum(axis=1), (x * x).sum(axis=1)
    top = max(norms.max(initial=0.0), size[np.isfinite(size)].max(initial=0.0))
    kind = np.float32 if top < 1e30 else np.float64
    turned, added = np.ascontiguousarray(-2.0 * c.T, kind), norms.astype(kind)
    for at in range(0, len(x), step):
        some = slice(at, at + step)
        index[some] = _nearest(x[some], size[some], c, turned, added)
    step = max(1, CELLS // max(1, c.shape[1]))
    for at in range(0, len(x), step):
        d = x[at : at + step] - c[index[at : at + step]]
        exact[at : at + step] = np.einsum("ij,ij->i", d, d)
    return index, exact


def _nearest(x: np.ndarray, size: np.ndarray, c: np.ndarray, turned: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """One matrix product (in single precision where norms allow) finds the candidates; where there are several within its
    rounding error of the best, they are measured by differences. size: of rows of x squared, turned: -2 c."""
    unit_ = (2 * c.shape[1] + 16) * float(np.finfo(turned.dtype).eps)
    with np.errstate(invalid="ignore", over="ignore"):
        rough = x.astype(turned.dtype) @ turned
        rough += norms
        index, rows = rough.argmin(axis=1), np.arange(len(x))
        most = float(norms.max(initial=0.0))
        cut = rough[rows, index].astype(np.float64) + unit_ * (most + 2.0 * np.sqrt(size * most)) + 4e-9
    index[~np.isfinite(cut)] = 0
    rough[rows, index] = np.inf
    tied = np.flatnonzero(rough.min(axis=1).astype(np.float64) <= cut)
    if len(tied):
        close = rough[tied] <= cut[tied, None]
        close[np.arange(len(tied)), index[tied]] = True
        i, j = np.nonzero(close)
        r = np.empty(len(i))
        step = max(1, CELLS // max(1, c.shape[1]))
        for at in range(0, len(i), step):
            d = x[tied[i[at : at + step]]] - c[j[at : at + step]]
            r[at : at + step] = np.round(np.einsum("ij,ij->i", d, d), 9)
        first = np.flatnonzero(r == np.minimum.reduceat(r, np.searchsorted(i, np.arange(len(tied))))[i])
        who, place = np.unique(i[first], return_index=True)
        index[tied[who]] = j[first[place]]
    return index


def summed(index: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """k x dimension: the sums of rows of x by their index."""
    d = x.shape[1]
    return np.bincount((index[:, None] * d + np.arange(d)).ravel(), x.ravel(), k * d).reshape(k, d) if len(x) else np.zeros((k, d))


def hashes(x: np.ndarray) -> np.ndarray:
    """64 bits of each row's numbers."""
    odd = np.random.default_rng(1).integers(0, 1 << 63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    return _mixed((np.ascontiguousarray(x, np.float64).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64))


def fingerprint(hashed: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A number that says which row has which index, in whatever order the rows come: sums of it over batches and tasks
    (modulo 2^64) are equal if no index has changed, and differ otherwise but for one chance in 2^64."""
    return _mixed(hashed + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Best:
    """The k smallest (distance, key) of each query seen so far; ties to 9 places go to the smaller key. Neither NaN nor
    infinite distances enter. Holds queries x k pairs; keys keep their own type."""

    def __init__(self, queries: int, k: int):
        if k < 1:
            raise ValueError("k must be positive")
        self.k = k
        self.distance = np.full((queries, k), np.inf)
        self.key: np.ndarray | None = None

    def worst(self, rows: np.ndarray) -> np.ndarray:
        """Beyond which nothing enters for the queries in rows."""
        return self.distance[rows, -1]

    def add(self, rows: np.ndarray, distance: np.ndarray, key: np.ndarray) -> None:
        """distance: len(rows) x n for the queries in rows; key: n."""
        n = distance.shape[1]
        if not n or not len(rows):
            return
        if self.key is None:
            self.key = np.empty(self.distance.shape, key.dtype)
        # In the order of keys, the first of some equal distances is the one that counts.
        order = np.argsort(key, kind="stable")
        key, step = key[order], max(1, CELLS // n)
        for at in range(0, len(rows), step):
            self._add(rows[at : at + step], distance[at : at + step][:, order], key)

    def _add(self, rows: np.ndarray, d: np.ndarray, key: np.ndarray) -> None:
        r = np.round(d, 9)
        r[~np.isfinite(r)] = np.inf
        cut = np.round(self.worst(rows), 9)
        if r.shape[1] > self.k:
            cut = np.minimum(cut, np.partition(r, self.k - 1, axis=1)[:, self.k - 1])
        near = (r <= cut[:, None]) & (r < np.inf)
        for i in np.flatnonzero(near.sum(axis=1) > self.k):  # many as far as the kth
            same = np.flatnonzero(r[i] == cut[i])
            near[i, same[self.k - int((r[i] < cut[i]).sum()) :]] = False
        i, j = np.nonzero(near)
        if not len(i):
            return
        self.put(rows[i], d[i, j], key[j])

    def put(self, query: np.ndarray, dist: np.ndarray, name: np.ndarray) -> None:
        """Offers single pairs of a query's number and a key."""
        if self.key is None:
            self.key = np.empty(self.distance.shape, name.dtype)
        touched = np.unique(query)
        held = np.isfinite(self.distance[touched])
        query = np.concatenate([touched[np.nonzero(held)[0]], query])
        dist = np.concatenate([self.distance[touched][held], dist])
        name = np.concatenate([self.key[touched][held], name])
        order = np.lexsort((_ranks(name), np.round(dist, 9), query))
        query, dist, name = query[order], dist[order], name[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.distance[touched] = np.inf
        self.distance[query[kept], place[kept]] = dist[kept]
        self.key[query[kept], place[kept]] = name[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, key, distance of all that were kept."""
        if self.key is None:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        has = np.isfinite(self.distance)
        return np.nonzero(has)[0], self.key[has], self.distance[has]


def _ranks(names: np.ndarray) -> np.ndarray:
    return names if names.dtype != object else np.unique(names, return_inverse=True)[1]


def keys_of(column: pa.Array) -> np.ndarray:
    """Whole numbers as such, anything else as objects."""
    whole = pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy(zero_copy_only=False) if whole else np.array([*column.to_pylist(), None], object)[:-1]
