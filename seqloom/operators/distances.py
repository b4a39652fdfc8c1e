"""Distances between all rows of a group, worked on block against block.

A block holds at most about ``BLOCK`` rows; a task compares two blocks and
returns a row for each of their rows, or counts, never the pairs. The work
grows with the square of a group, as the statistic itself does; no task and
no shuffled row does. Two blocks meet once, for the rows of both.

States are held as bits: rows differ at the columns where one of five bits
does. Where only near pairs are asked for, four bits of the 64 most variable
columns come first; they never show more differences than there are, and what
they leave over is compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.alignment import Q
from seqloom.session import stored

#: Rows of a block; the larger, the less often a row is sent.
BLOCK = 65_536
#: Rows that are compared at a time, on either side.
DOWN, ACROSS = 8, 4_096
GAP_AWARE, HAMMING = "gap-aware", "hamming"


# --- kernels ------------------------------------------------------------------------------------------------------


def _words(bits: np.ndarray) -> list[np.ndarray]:
    """Rows of bits in words of 64, then in one of 32, 16 and 8 as far as they are needed."""
    packed = np.packbits(bits, axis=1)
    out, at, left = [], 0, packed.shape[1]
    for size in (8, 4, 2, 1):
        while left >= size or (size == 1 and left):
            out.append(np.ascontiguousarray(packed[:, at : at + size]).view(f"u{size}").ravel())
            at, left = at + size, left - size
    return out


def _planes(x: np.ndarray, n_bits: int = 5) -> list[list[np.ndarray]]:
    """For each word the planes of its bits."""
    each = [_words((x >> k) & 1) for k in range(n_bits)]
    return [list(word) for word in zip(*each, strict=True)]


class _Counter:
    """Counts of columns in which rows of ``a`` and ``b`` differ, for some rows at a time."""

    def __init__(self, a: list[list[np.ndarray]], b: list[list[np.ndarray]]):
        self.a, self.b = a, b
        self.room = [[np.empty(DOWN * ACROSS, planes[0].dtype) for _ in range(2)] for planes in a]
        self.bits = np.empty(DOWN * ACROSS, np.uint8)
        self.total = np.empty(DOWN * ACROSS, np.uint8 if 8 * sum(p[0].dtype.itemsize for p in a) < 256 else np.uint32)

    def __call__(self, i: slice, j: slice, both: bool = False) -> np.ndarray:
        """Rows i by rows j; ``both``: bits that are set in both instead."""
        shape = (i.stop - i.start, j.stop - j.start)
        size = shape[0] * shape[1]
        total, bits = self.total[:size].reshape(shape), self.bits[:size].reshape(shape)
        for k, (p, q, room) in enumerate(zip(self.a, self.b, self.room, strict=True)):
            one, two = (r[:size].reshape(shape) for r in room)
            if both:
                np.bitwise_and(p[0][i, None], q[0][None, j], out=one)
            else:
                np.bitwise_xor(p[0][i, None], q[0][None, j], out=one)
            for u, v in zip(p[1:], q[1:], strict=True):
                np.bitwise_xor(u[i, None], v[None, j], out=two)
                np.bitwise_or(one, two, out=one)
            if k:
                np.bitwise_count(one, out=bits)
                np.add(total, bits, out=total)
            else:
                np.bitwise_count(one, out=total)
        return total


def _tiles(n: int, m: int, alone: bool) -> Iterator[tuple[slice, slice]]:
    """Parts of the matrix of n by m rows, or of what is above its diagonal and some beside it."""
    for j in range(0, m, ACROSS):
        end = min(j + ACROSS, m)
        for i in range(0, min(n, end) if alone else n, DOWN):
            stop = min(i + DOWN, n)
            yield slice(i, stop), slice(max(j, i + 1) if alone else j, end)


def _variable(x: np.ndarray, k: int) -> np.ndarray:
    """The columns with the most even states."""
    squares = sum((x == s).mean(axis=0) ** 2 for s in range(Q))
    return np.argsort(squares, kind="stable")[:k]


def _first(a: np.ndarray, b: np.ndarray) -> _Counter:
    columns = _variable(b, 64)
    return _Counter(_planes(a[:, columns], 4), _planes(b[:, columns], 4))


class _Rows:
    """Rows whose pairs are compared one by one."""

    def __init__(self, x: np.ndarray):
        self.width, self.planes, self.gaps = x.shape[1], _planes(x), _words(x == 0)


def _pairwise(a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray, kind: str = GAP_AWARE) -> np.ndarray:
    """The distances of rows i of a to rows j of b, side by side; infinite where they are not defined."""
    differ, norm = np.zeros(len(i), np.int64), np.full(len(i), a.width)
    for p, q, g, h in zip(a.planes, b.planes, a.gaps, b.gaps, strict=True):
        x = p[0][i] ^ q[0][j]
        for u, v in zip(p[1:], q[1:], strict=True):
            x |= u[i] ^ v[j]
        differ += np.bitwise_count(x)
        if kind != HAMMING:
            norm -= np.bitwise_count(g[i] & h[j])
    return _apart(norm - differ, norm)


def _places(some: np.ndarray, i: slice, j: slice, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a tile's pairs that are set; ``alone``: those above the diagonal."""
    r, c = np.divmod(np.flatnonzero(some), max(1, some.shape[1]))
    r, c = r + i.start, c + j.start
    return (r[c > r], c[c > r]) if alone and j.start < i.stop else (r, c)


def _apart(same: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The distance; infinite where it is not defined."""
    return np.where(norm > 0, 1 - same / np.maximum(norm, 1), np.inf)


def near_pairs(a: np.ndarray, b: np.ndarray | None, theta: float, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b (or of a alone, the first before the second) nearer than theta."""
    alone, b = b is None, a if b is None else b
    # a distance below theta leaves fewer than theta * norm differences, and norm is at most the width
    most = min(max(int(np.floor(theta * a.shape[1] + 1e-6)), -1), 254)
    if most < 0:
        return
    first, held, size = _first(a, b), [], 0
    one, two = _Rows(a), _Rows(b)

    def settle() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(z) for z in zip(*held, strict=True))
        ok = _pairwise(one, i, two, j, kind) < theta
        return i[ok], j[ok]

    for i, j in _tiles(len(a), len(b), alone):
        r, c = _places(first(i, j) <= most, i, j, alone)
        if len(r):
            held.append((r, c))
            size += len(r)
            if size > 50_000:
                yield settle()
                held, size = [], 0
    if held:
        yield settle()


# --- blocks -------------------------------------------------------------------------------------------------------


def distinct_rows(rows: DataFrame, group: str, key: str, states: str) -> tuple[DataFrame, DataFrame]:
    """Of the rows of a group with equal states one: group, _h, _h2, _k (the least key), _s, _c (how many they are); and all rows' keys with their hashes."""
    x = stored(rows.select(group, F.col(key).alias(key), F.col(states).cast("array<tinyint>").alias("_s")))
    reps = x.groupBy(group, "_s").agg(F.min(key).alias("_k"), F.count("*").alias("_c"))
    hashes = {"_h": F.xxhash64("_s"), "_h2": F.xxhash64(F.lit(7), "_s")}
    return stored(reps.withColumns(hashes)), x.select(group, key, *[h.alias(n) for n, h in hashes.items()])


def _matrix(t: pa.Table) -> np.ndarray:
    """States of rows of one length; null and out of range become gaps."""
    s = t.column("_s").combine_chunks()
    x = s.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(len(t), -1)
    return np.where((x < 0) | (x >= Q), 0, x).astype(np.uint8)


def _blocks(reps: DataFrame, group: str, name: str) -> DataFrame:
    sizes = reps.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"_n{name}"))
    return reps.select(group, "_k", "_c", "_s").join(sizes, group).withColumn("_b", F.pmod(F.xxhash64("_k"), F.col(f"_n{name}")).cast("int"))


#: Partitions of block pairs at most.
MOST_PARTITIONS = 4_000


def _partitions(left: DataFrame, right: DataFrame | None, group: str) -> int:
    """Twice as many as there are pairs of blocks: as each takes long, hardly two should wait for each other."""
    n = lambda df, c: df.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias(c))
    x = n(left, "_a")
    x = x.select((F.col("_a") * (F.col("_a") + 1) / 2).alias("_p")) if right is None else x.join(n(right, "_b"), group).select((F.col("_a") * F.col("_b")).alias("_p"))
    pairs = x.agg(F.sum("_p")).first()[0] or 0
    return min(MOST_PARTITIONS, max(2 * int(pairs), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


#: What a task makes of two blocks: the rows' keys, counts and states of one and of the other, which is None for a block with itself.
Reduce = Callable[[tuple, "tuple | None"], dict[str, np.ndarray]]


def compare(left: DataFrame, right: DataFrame | None, reduce: Reduce, group: str, schema: str) -> DataFrame:
    """group and what ``reduce`` returns for each two blocks of a group; both are ``distinct_rows``. Without ``right`` the blocks of ``left`` meet each other once."""
    x = _blocks(left, group, "l")
    n = lambda df, c: df.groupBy(group).agg(F.max(c).alias(c))
    if right is None:
        x = x.select(group, "_k", "_c", "_s", "_b", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1)).alias("_o"))
        both = x.select(group, "_k", "_c", "_s", (F.col("_b") > F.col("_o")).cast("int").alias("_side"), F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"))
    else:
        y = _blocks(right, group, "r")
        x, y = x.join(n(y, "_nr"), group), y.join(n(x, "_nl"), group)
        x = x.select(group, "_k", "_c", "_s", F.lit(0).alias("_side"), F.col("_b").alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)).alias("_y"))
        y = y.select(group, "_k", "_c", "_s", F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0), F.col("_nl") - 1)).alias("_x"), F.col("_b").alias("_y"))
        both = x.unionByName(y)
    both = both.repartition(_partitions(left, right, group), group, "_x", "_y")
    names, alone = [c.split()[0] for c in schema.split(", ")], right is None

    def task(key: tuple, t: pa.Table) -> pa.Table:
        side, k, c = (t.column(z).to_numpy() for z in ("_side", "_k", "_c"))
        s = _matrix(t)
        one, two = ((k[side == z], c[side == z], s[side == z]) for z in (0, 1))
        itself = alone and key[1].as_py() == key[2].as_py()
        got = reduce(one, None if itself else two) if s.shape[1] and len(one[0]) and (itself or len(two[0])) else {z: np.zeros(0) for z in names}
        values = {z: pa.array(got[z], pa.float64() if f"{z} double" in schema else pa.int64()) for z in names}
        return pa.table({group: pa.array([key[0].as_py()] * len(values[names[0]]), pa.string())} | values)

    task.__annotations__ = {"key": tuple, "t": pa.Table, "return": pa.Table}
    return both.groupBy(group, "_x", "_y").applyInArrow(task, f"{group} string, {schema}")


def _to_all(values: DataFrame, reps: DataFrame, keys: DataFrame, group: str, key: str) -> DataFrame:
    """The values of distinct rows for each row that they stand for."""
    v = reps.select(group, "_h", "_h2", "_k").join(values, [group, "_k"]).drop("_k")
    return keys.join(v, [group, "_h", "_h2"]).drop("_h", "_h2")


# --- statistics ---------------------------------------------------------------------------------------------------


def weights(rows: DataFrame, theta: float, group: str = "family", key: str = "seq_id", states: str = "states", kind: str = GAP_AWARE) -> DataFrame:
    """group, key, neighbours (rows nearer than ``theta``, itself included) and w = 1 / neighbours.

    An undefined distance is no neighbour; a row counts as its own neighbour
    even where its distance to itself is undefined. Equal rows are compared
    once.
    """

    def near(one: tuple, two: tuple | None) -> dict[str, np.ndarray]:
        k, c, a = one
        out = np.zeros(len(k), np.int64)
        if two is None:
            # its equals, unless their distance is undefined
            own = np.arange(len(k))
            out += np.where(_pairwise(_Rows(a), own, _Rows(a), own, kind) < theta, c, 1)
            for i, j in near_pairs(a, None, theta, kind):
                np.add.at(out, i, c[j])
                np.add.at(out, j, c[i])
            return {"_k": k, "value": out}
        others = np.zeros(len(two[0]), np.int64)
        for i, j in near_pairs(a, two[2], theta, kind):
            np.add.at(out, i, two[1][j])
            np.add.at(others, j, c[i])
        some, more = out > 0, others > 0
        return {"_k": np.concatenate([k[some], two[0][more]]), "value": np.concatenate([out[some], others[more]])}

    reps, keys = distinct_rows(rows, group, key, states)
    n = compare(reps, None, near, group, "_k long, value long").groupBy(group, "_k").agg(F.sum("value").alias("neighbours"))
    return _to_all(n, reps, keys, group, key).withColumn("w", 1 / F.col("neighbours"))


#: Rows with which each is compared beforehand, so that most others are soon out of the question.
BEFORE = 32


def _nearest(a: np.ndarray, b: np.ndarray | None, least: np.ndarray, other: np.ndarray) -> None:
    """Lowers ``least`` (of a's rows) and ``other`` (of b's) to the distance of the nearest row on the other side; without b both are of a's rows, and the row itself doesn't count."""
    alone, b = b is None, a if b is None else b
    width = a.shape[1]
    one, two = _Rows(a), _Rows(b)
    first, full, gaps = _first(a, b), _Counter(one.planes, two.planes), _Counter([[w] for w in one.gaps], [[w] for w in two.gaps])
    if alone:
        other = least

    def top(d: np.ndarray) -> np.ndarray:
        """Differences up to which a pair may be nearer."""
        return np.minimum(np.ceil(np.minimum(d, 1) * width + 1e-6), 65_535).astype(np.uint16 if width > 254 else np.uint8)

    def settle(r: np.ndarray, c: np.ndarray) -> None:
        d = _pairwise(one, r, two, c)
        np.minimum.at(least, r, d)
        np.minimum.at(other, c, d)

    n = np.arange(max(len(a), len(b)))
    for k in range(1, BEFORE + 1):
        if alone and k < len(a):
            settle(n[:-k], n[k:])
        elif not alone:
            settle(n % len(a), (n + k * 257) % len(b))
    mine = top(least)
    theirs = mine if alone else top(other)
    missed = 0
    for at, (i, j) in enumerate(_tiles(len(a), len(b), alone)):
        # while the first columns leave over too much, they are asked in one tile of 16
        for count in (full,) if missed > 3 and at % 16 else (first, full):
            differ = count(i, j)
            some = (differ <= mine[i, None]) | (differ <= theirs[None, j])
            # a tile of which much is left is counted in full first, and with its gaps
            much = np.count_nonzero(some) * 32 > some.size
            if count is first:
                missed = missed + 1 if much else 0
            if not much:
                break
        else:
            norm = (width - gaps(i, j, both=True).astype(np.float32)).clip(1)
            d = differ / norm
            some &= (d <= least[i, None].astype(np.float32) + np.float32(1e-5)) | (d <= other[None, j].astype(np.float32) + np.float32(1e-5))
        r, c = _places(some, i, j, alone)
        if len(r):
            settle(r, c)
            mine[r], theirs[c] = top(least[r]), top(other[c])


def nearest(left: DataFrame, right: DataFrame | None = None, group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """group, key and d: the gap-aware distance to the nearest row of ``right`` (or of the own group but itself); rows without a defined one are left out.

    Equal rows are compared once.
    """
    alone = right is None

    def least(one: tuple, two: tuple | None) -> dict[str, np.ndarray]:
        # of two tables only the first one's distances are asked for
        d = [np.full(len(one[0]), np.inf), np.full(len((two or one)[0]), np.inf if alone else 0)]
        order = [_like(x[2]) for x in (one, two or one)]
        a, b = one[2][order[0]], None if two is None else two[2][order[1]]
        _nearest(a, b, d[0], d[1])
        k = [x[0][o] for x, o in zip((one, two or one), order, strict=True)]
        if two is None:
            # a row that comes several times has an equal one beside itself
            d[0] = np.where((one[1][order[0]] > 1) & (a > 0).any(axis=1), 0, d[0])
        if two is None or not alone:
            return {"_k": k[0], "value": d[0]}
        return {"_k": np.concatenate(k), "value": np.concatenate(d)}

    reps, keys = distinct_rows(left, group, key, states)
    others = None if alone else distinct_rows(right, group, key, states)[0]
    out = compare(reps, others, least, group, "_k long, value double").groupBy(group, "_k").agg(F.min("value").alias("d"))
    return _to_all(out.where(F.col("d") < float("inf")), reps, keys, group, key)


def _like(x: np.ndarray, pivots: int = 24) -> np.ndarray:
    """An order in which rows that are nearest to the same of some rows stand together, fragments last, so that tiles hold near or far pairs; it changes no result."""
    some = _Rows(x[:: max(1, len(x) // pivots)][:pivots])
    mine, n = _Rows(x), np.arange(len(x))
    at = np.stack([_pairwise(mine, n, some, np.full(len(x), k), HAMMING) for k in range(len(some.gaps[0]))]).argmin(axis=0)
    return np.lexsort((at, np.count_nonzero(x == 0, axis=1) * 4 > x.shape[1]))


def distance_histogram(rows: DataFrame, bins: int = 20, group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """group, bin and n: pairs of rows by their gap-aware distance in ``bins`` steps from 0 to 1, the last closed. Equal rows are compared once."""

    def count(one: tuple, two: tuple | None) -> dict[str, np.ndarray]:
        alone = two is None
        # rows that come equally often stand together, so that all pairs of a tile count alike
        (c, a), (e, b) = ((x[1][o], x[2][o]) for x in (one, two or one) for o in [np.argsort(x[1], kind="stable")])
        width = a.shape[1]
        full, gaps = _Counter(_planes(a), _planes(b)), _Counter([[w] for w in _words(a == 0)], [[w] for w in _words(b == 0)])
        # pairs by norm and differences
        n = np.zeros((width + 1) ** 2, np.int64)
        by_count = [np.append(np.flatnonzero(np.diff(z, prepend=0)), len(z)) for z in (c, e)]
        for i, j in _tiles(len(a), len(b), alone):
            code = gaps(i, j, both=True).astype(np.uint16 if width < 255 else np.uint32)
            np.subtract(width, code, out=code)
            code *= width + 1
            code += full(i, j)
            if alone and j.start < i.stop:
                keep = np.arange(i.start, i.stop)[:, None] < np.arange(j.start, j.stop)[None]
            else:
                keep = None
            for r, s in _runs(by_count[0], i):
                for u, v in _runs(by_count[1], j):
                    part = code[r - i.start : s - i.start, u - j.start : v - j.start]
                    part = part[keep[r - i.start : s - i.start, u - j.start : v - j.start]] if keep is not None else part.ravel()
                    n += np.bincount(part, minlength=len(n)) * (c[r] * e[u])
        if alone:
            # the pairs among equal rows
            norm = np.count_nonzero(a, axis=1)
            np.add.at(n, norm * (width + 1), c * (c - 1) // 2)
        norm, differ = np.divmod(np.flatnonzero(n), width + 1)
        d = _apart(norm - differ, norm)
        at = np.minimum(np.floor(np.round(np.where(norm > 0, d, 0) * bins, 9)).astype(int), bins - 1)
        out = np.zeros(bins, np.int64)
        np.add.at(out, at[norm > 0], n[n > 0][norm > 0])
        return {"bin": np.flatnonzero(out), "n": out[out > 0]}

    reps, _ = distinct_rows(rows, group, key, states)
    parts = compare(reps, None, count, group, "bin long, n long")
    return parts.groupBy(group, F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def _runs(starts: np.ndarray, of: slice) -> Iterator[tuple[int, int]]:
    """The pieces into which some beginnings cut a slice."""
    inner = starts[(starts > of.start) & (starts < of.stop)]
    edges = [of.start, *inner.tolist(), of.stop]
    return ((r, s) for r, s in zip(edges[:-1], edges[1:], strict=True) if r < s)
