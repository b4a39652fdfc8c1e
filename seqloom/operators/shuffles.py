"""Columns of an alignment permuted on their own, by draws, without a row for each cell.

Rows are packed by group and ``COLUMNS`` columns, column after column, and a
task permutes the columns of one group: it holds a few tens of bytes for each
row of the group, never the cells of all its columns. Draws are the first
four bytes of MD5 digests, computed for many keys at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a task permutes, and rows that are packed together.
COLUMNS, ROWS = 32, 1 << 16
#: Digests that are computed at a time, so that they stay in a core's cache.
DIGESTS = 1 << 14

# --- draws --------------------------------------------------------------------------------------------------------

_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _word(i: int) -> int:
    return (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16


def _first_words(words: list, n: int) -> np.ndarray:
    """The first word of the MD5 digests of n messages of one block; words are arrays or numbers. The last three steps make other words."""
    a, b, c, d = (np.full(n, z, np.uint32) for z in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        word, turn = words[_word(i)], _TURNS[i // 16][i % 4]
        if isinstance(word, int):
            a += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            a += word
            a += np.uint32(_SINES[i])
        np.left_shift(a, np.uint32(turn), out=t)
        a >>= np.uint32(32 - turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return b + np.uint32(_START[0])


class Draws:
    """``alignment.draw(seed, pos, key)`` for whole numbers as keys, by column."""

    def __init__(self, seed: str, keys: np.ndarray):
        self.seed, self.n = seed.encode(), len(keys)
        text = keys.astype(np.int64).astype("S20")
        raw = text.view(np.uint8).reshape(self.n, 20)
        size = np.count_nonzero(raw, axis=1)
        # keys by the length of their text
        self.parts = [(np.flatnonzero(size == z), raw[size == z, :z]) for z in np.unique(size)]
        self.ready: tuple[int, list] = (-1, [])

    def _ends(self, before: int) -> list:
        """For each part its messages' words, of which the first bytes are left 0, and their number of bytes."""
        if self.ready[0] != before:
            out = []
            for _, digits in self.parts:
                size = before + digits.shape[1]
                if size > 55:
                    raise ValueError("a seed, a column and a key must fit a block of 55 bytes")
                block = np.zeros((len(digits), 4 * (size // 4 + 1)), np.uint8)
                block[:, before:size] = digits
                block[:, size] = 0x80
                out.append((np.ascontiguousarray(block.view("<u4").T), size))
            self.ready = before, out
        return self.ready[1]

    def __call__(self, pos: int) -> np.ndarray:
        head = self.seed + b":%d:" % pos
        out = np.empty(self.n, np.uint32)
        whole = len(head) // 4
        start = np.frombuffer(head + bytes(-len(head) % 4), "<u4").tolist()
        for (at, _), (ends, size) in zip(self.parts, self._ends(len(head)), strict=True):
            got = np.empty(len(at), np.uint32)
            for k in range(0, len(at), DIGESTS):
                part = ends[:, k : k + DIGESTS]
                words = [*start[:whole], *(part[w] | np.uint32(start[w] if w < len(start) else 0) for w in range(whole, len(part)))]
                words += [0] * (14 - len(words)) + [8 * size, 0]
                got[k : k + DIGESTS] = _first_words(words, part.shape[1])
            out[at] = got
        return out.byteswap()


# --- packed rows --------------------------------------------------------------------------------------------------


def _nothing(kind: np.dtype) -> int:
    """The number that stands for null and for columns that a row doesn't have."""
    return int(np.iinfo(kind).min)


def _as(cells: np.ndarray, kind: np.dtype) -> np.ndarray:
    return cells if cells.dtype == kind else np.where(cells == _nothing(cells.dtype), _nothing(kind), cells.astype(kind))


def _blob(keys: np.ndarray, size: np.ndarray, cells: np.ndarray) -> bytes:
    data = b"".join([np.diff(keys, prepend=0).tobytes(), size.astype(np.uint8).tobytes(), cells.T.tobytes()])
    return np.array([len(keys), cells.shape[1], cells.dtype.itemsize, len(data)], np.int64).tobytes() + pa.Codec("zstd", 1).compress(data).to_pybytes()


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sizes and cells by column."""
    n, width, each, size = np.frombuffer(blob[:32], np.int64).tolist()
    data = pa.Codec("zstd").decompress(blob[32:], size)
    cells = np.frombuffer(data, f"i{each}", n * width, 9 * n).reshape(width, n)
    return np.cumsum(np.frombuffer(data, np.int64, n)), np.frombuffer(data, np.uint8, n, 8 * n), cells


def _packed(t: pa.Table, columns: int) -> Iterator[tuple[str, int, bytes]]:
    """Group, number of the run of columns and blob, of rows of group, key and states."""
    group, states = t.column(0).combine_chunks().dictionary_encode(), t.column(2).combine_chunks()
    keys, of = t.column(1).to_numpy(), group.indices.to_numpy()
    ends = states.offsets.to_numpy().astype(np.int64)
    base, size = ends[0], np.diff(ends)
    flat = states.flatten()
    there = None if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
    flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
    lo, hi = (int(flat.min()), int(flat.max())) if len(flat) else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if lo > np.iinfo(k).min and hi <= np.iinfo(k).max)
    flat = flat.astype(kind)
    if there is not None:
        flat[~there] = _nothing(kind)
    flat = np.append(flat, kind(_nothing(kind)))
    order = np.lexsort((keys, of))
    for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
        for run in range(-(-int(size[rows].max(initial=0)) // columns)):
            some = rows[size[rows] > run * columns]
            left = np.minimum(size[some] - run * columns, columns)
            at = np.arange(int(left.max()))[None]
            cells = flat[np.where(at < left[:, None], ends[some][:, None] - base + run * columns + at, -1)]
            yield group.dictionary[int(of[rows[0]])].as_py(), run, _blob(keys[some], left, cells)


def shuffled_checksums(rows: DataFrame, group: str = "family", key: str = "seq_id", states: str = "states", seed: str = "shuffle") -> DataFrame:
    """group, key and checksum: the sum of the states of each row of ``alignment.shuffle_columns`` times their columns, counted from 1.

    Keys are whole numbers, once in a group. Null states add nothing; a row
    of nulls has a null checksum, one without columns is left out.
    """
    if dict(rows.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("keys must be whole numbers")
    x = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(states).isNotNull())
    x = x.select(F.col(group).cast("string"), F.col(key).cast("long"), F.col(states).cast("array<long>" if "bigint" in dict(rows.dtypes)[states] else "array<int>"))

    columns = COLUMNS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def emit() -> Iterator[pa.RecordBatch]:
            for g, run, blob in _packed(pa.Table.from_batches(waiting), columns):
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([run], pa.int32()), pa.array([blob], pa.binary())], names=[group, "_run", "_data"])

        for b in batches:
            waiting.append(b)
            if sum(w.num_rows for w in waiting) >= ROWS:
                yield from emit()
                waiting = []
        if waiting:
            yield from emit()

    def shuffle(run: tuple, t: pa.Table) -> pa.Table:
        parts = [_unblob(b.as_py()) for b in t.column("_data")]
        kind = np.result_type(*[c.dtype for _, _, c in parts])
        parts = [(k, n, _as(c, kind)) for k, n, c in parts]
        keys, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, size = keys[order], size[order]
        draws, rank = Draws(seed, keys), np.arange(len(keys), dtype=np.uint64)
        sums, some = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for p in range(int(size.max())):
            mine = np.concatenate([c[p] if p < len(c) else np.full(c.shape[1], _nothing(kind), kind) for _, _, c in parts])[order]
            pos = run[1].as_py() * columns + p
            z = draws(pos).astype(np.uint64) << np.uint64(32) | rank
            to = slice(None)
            if (size <= p).any():
                # rows that end before the column have no part in it
                to = np.flatnonzero(size > p)
                z = z[to]
            z.sort()
            state = mine[(z & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            ok = state != _nothing(state.dtype)
            sums[to] += np.where(ok, state.astype(np.int64) * (pos + 1), 0)
            some[to] |= ok
        return pa.table({group: pa.array([run[0].as_py()] * len(keys), pa.string()), key: pa.array(keys), "checksum": pa.array(sums, mask=~some)})

    shuffle.__annotations__ = {"run": tuple, "t": pa.Table, "return": pa.Table}
    packed = x.mapInArrow(pack, f"{group} string, _run int, _data binary")
    sums = packed.groupBy(group, "_run").applyInArrow(shuffle, f"{group} string, {key} long, checksum long")
    return sums.groupBy(group, key).agg(F.sum("checksum").alias("checksum"))
