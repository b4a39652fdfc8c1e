"""Near-duplicate sequences under edits and one block move, by generalised pigeonhole.

The bits of a sequence are its k-mers. With at most ``e`` edits and one block
move, which cuts a sequence in three places, a sequence of ``e + 4`` disjoint
stretches keeps one of them whole in any near duplicate. The longer of two
sequences probes, so that ``e`` is a tenth of its own length. Its letters are
cut into ``e + 4`` stretches of two neighbouring lengths, some letters left
over; where the cuts lie is settled by dynamic programming on the candidates
that each stretch is expected to give. (A stretch has a threshold of 0, a
letter left over one of -1; a longer stretch with a threshold of 1 is the same
as its halves with 0 each.) The other sequence is found at any of its k-mers
of the lengths that such longer ones use. Only k-mers that some sequence
probes and that stand in two sequences are sent. Candidates are told by their
letters' counts, then verified (``edits``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.edits import CELLS, CUTS, TENTH, budget, by_length, padded, verify
from seqloom.session import checkpoint, stored

#: Length of the k-mers whose frequent ones are counted, and slots of the table of their counts.
K = 6
SLOTS = 1 << 20
#: A k-mer in so many of the rows that a task looks at together is counted.
FREQUENT = 16
#: Frequent k-mers that are kept, the most frequent ones; with it, the size of what is gathered.
MOST_FREQUENT = 1 << 18
#: Bits of the tables of k-mers that are probed, and that stand in two rows, and the pieces in which they are gathered.
PROBED, TWICE = 1 << 28, 1 << 27
PIECES = 64
#: Rows of a k-mer that are worked on together; more are spread over a grid of groups.
HOT = 20_000
#: Postings that one task holds.
POSTINGS = 1_000_000
#: Rows up to which a table of rows is broadcast; a larger one is joined.
MOST_BROADCAST = 1_000_000
#: Pairs whose texts are verified together: their number, and their letters.
TOGETHER, LETTERS_TOGETHER = 60_000, 100_000_000


# --- stretches ----------------------------------------------------------------------------------------------------


def needed(size):
    """Disjoint stretches of which operations on it and a text no longer leave one whole; a text of under four letters has no edits, and one letter is enough."""
    return np.minimum(budget(size) + CUTS + 1, np.maximum(size, 1))


def stretch_length(size):
    """The shorter of the two lengths of a text's stretches."""
    return size // needed(size)


@lru_cache(maxsize=1 << 16)
def _lengths(size: int) -> int:
    """Bits of the stretch lengths that texts of this length and the longer ones that can be near it use."""
    out = 0
    for n in np.unique(np.concatenate([np.arange(size, min(size + size // (TENTH - 1), size + 400) + 1), [size + size // (TENTH - 1)]])):
        k, over = int(stretch_length(n)), int(n - needed(n) * stretch_length(n))
        out |= 1 << k | (1 << k + 1 if over else 0)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def _grams(x: np.ndarray, k: int, kind=np.int64) -> np.ndarray:
    """All k-mers as numbers, by doubling the length."""
    if x.shape[1] < k:
        return np.zeros((len(x), 0), kind)
    power, out, have = (x & 31).astype(kind), None, 0
    n = 1
    while n <= k:
        if k & n:
            out = power[:, : x.shape[1] - n + 1] if out is None else (power[:, : x.shape[1] - n - have + 1] << 5 * have) | out[:, n : n + x.shape[1] - n - have + 1]
            have += n
        if 2 * n <= k:
            power = (power[:, : power.shape[1] - n] << 5 * n) | power[:, n:]
        n *= 2
    return out


def _key(gram: np.ndarray, k: int) -> np.ndarray:
    return gram * 16 + k


def _slot(gram: np.ndarray) -> np.ndarray:
    return (_mix(gram) >> np.uint64(44)).astype(np.int64)


def allocate(x: np.ndarray, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the ``needed`` stretches of texts of one length, of least expected candidates.

    A stretch is expected to give as many candidates as the rarest k-mer in
    it. Step by step over the stretches, for each number of letters used
    beyond the shorter length so far, the least cost is kept.
    """
    n, need, k = len(x), int(needed(size)), int(stretch_length(size))
    over = size - need * k
    if not over:
        return np.tile(np.arange(need) * k, (n, 1)), np.full((n, need), k)
    g = np.zeros((size + 1, n), np.float32)
    if size >= K:
        g[: size - K + 1] = table[_slot(_grams(x[:, :size], K))].T
        g[size - K + 1 :] = g[size - K]
    short = g[: size - k + 1].copy()
    for j in range(1, k - K + 1):
        np.minimum(short, g[j : j + len(short)], out=short)
    long = np.minimum(short, g[max(0, k + 1 - K) : max(0, k + 1 - K) + len(short)])[: size - k] if k >= K else short[: size - k]
    best = np.zeros((over + 1, n), np.float32)
    took = np.zeros((need, over + 1, n), np.int8)  # 0: the shorter, 1: the longer, 2: a letter is left over
    for i in range(need):
        at = k * i
        new = best + short[at : at + over + 1]
        more = best[:-1] + long[at : at + over]
        took[i, 1:] = more < new[1:]
        np.minimum(new[1:], more, out=new[1:])
        best = np.minimum.accumulate(new, axis=0)
        took[i][best < new] = 2
    start, length = np.zeros((n, need), np.int64), np.zeros((n, need), np.int64)
    rows, s = np.arange(n), np.full(n, over)
    for i in range(need - 1, -1, -1):
        while True:
            skip = took[i, s, rows] == 2
            if not skip.any():
                break
            s = s - skip
        longer = took[i, s, rows]
        s = s - longer
        start[:, i], length[:, i] = k * i + s, k + longer
    return start, length


def probes(x: np.ndarray, size: np.ndarray, table: np.ndarray) -> list[bytes]:
    """The stretches of each row as numbers of two bytes: twice the letters used beyond the shorter length before it, and whether it is the longer one."""
    out: list[bytes] = [b""] * len(size)
    order = np.argsort(size, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(size[order]))[0] + 1) if len(order) else ():
        n = int(size[rows[0]])
        if not n:
            continue
        need, k = int(needed(n)), int(stretch_length(n))
        step = max(1, CELLS // (need * (n - need * k + 1)))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            start, length = allocate(x[part], n, table)
            code = ((start - k * np.arange(need)) * 2 + (length - k)).astype("<u2")
            for r, c in zip(part, code, strict=True):
                out[r] = c.tobytes()
    return out


# --- tables of rows -----------------------------------------------------------------------------------------------

#: Fixed: the letters of states 0 to 20; any other state has its own sign.
LETTERS = np.frombuffer(b"-ACDEFGHIKLMNPQRSTVWY" + b"?" * 235, np.uint8)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and lengths of an Arrow column of texts."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return flat, np.diff(ends).astype(np.int64)


def _residues(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters without gaps, and their number in each row (0 for null), of an Arrow column of arrays of states."""
    flat = column.flatten()
    flat = flat.fill_null(0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy()
    size = np.diff(column.offsets.to_numpy()) * ~column.is_null().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size)])
    there = flat != 0
    n = np.concatenate([[0], np.cumsum(there)])[ends]
    flat = flat[there]
    return LETTERS[np.where((flat < 0) | (flat > 20), 21, flat).astype(np.uint8)], np.diff(n)


def _together(batches: Iterator[pa.RecordBatch], letters, cells: int = CELLS // 2) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches in larger runs of bounded letters: the rows, their letters as a padded matrix, and the lengths."""
    waiting: list[pa.RecordBatch] = []
    flats: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def emit() -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        rows, flat, size = pa.Table.from_batches(waiting), np.concatenate(flats), np.concatenate(sizes)
        if len(size) * size.max(initial=0) <= 4 * cells:
            yield rows, padded(flat, size), size
            return
        ends = np.concatenate([[0], np.cumsum(size)])
        for k in by_length(size, cells):
            yield rows.take(pa.array(k)), padded(np.concatenate([flat[ends[r] : ends[r + 1]] for r in k]), size[k]), size[k]

    for batch in batches:
        if batch.num_rows:
            flat, size = letters(batch)
            waiting.append(batch)
            flats.append(flat)
            sizes.append(size)
        if sum(map(len, flats)) >= cells or sum(map(len, sizes)) >= 1 << 18:
            yield from emit()
            waiting, flats, sizes = [], [], []
    if waiting:
        yield from emit()


def _of_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _flat(batch.column("s"))


def frequent_counts(rows: DataFrame, states: str) -> np.ndarray:
    """In how many rows each frequent k-mer stands: the table of expected candidates, by slot.

    A k-mer is counted where at least ``FREQUENT`` of the rows that a task
    looks at together have it; the others are taken as rare.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, size in _together(batches, lambda b: _residues(b.column(0))):
            g = _grams(x, K, np.uint32)
            g = np.sort(g[np.arange(g.shape[1])[None] <= (size - K)[:, None]])
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            n = np.diff(start, append=len(g))
            often = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(g[start[often]].astype(np.int64)), pa.array(n[often])], names=["gram", "n"])

    found = rows.select(states).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).toPandas()
    gram, n = top["gram"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    table = np.ones(SLOTS, np.float32)
    np.maximum.at(table, _slot(gram), n.astype(np.float32))
    return table


def text_table(rows: DataFrame, key: str, states: str, loaded: str, shared) -> DataFrame:
    """seq_id, loaded, s (letters without gaps, empty for null) and pr (its probes), written to the shared folder, and the hashes h and h2 of s."""
    base = rows.select(F.col(key).alias("seq_id"), F.col(loaded).alias("loaded"), F.col(states).alias("states"))
    schema = base.select("seq_id", "loaded", F.lit("").alias("s"), F.lit(b"").alias("pr")).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, size in _together(batches, lambda b: _residues(b.column(2))):
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = np.ascontiguousarray(x[np.arange(x.shape[1])[None] < size[:, None]])
            text = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes()))
            own = pa.array(probes(x, size, shared.value), pa.binary())
            ids, when = (part.column(c).combine_chunks() for c in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, when, text, own], names=["seq_id", "loaded", "s", "pr"])

    # texts are told apart by 96 bits, which are made again where they are used, not stored
    return stored(base.mapInArrow(make, schema)).withColumns({"h": F.xxhash64("s"), "h2": F.pmod(F.xxhash64(F.lit(7), "s"), F.lit((1 << 31) - 1)).cast("int")})


#: Rows whose k-mers are worked on at a time, so that they stay in a core's cache.
BLOCK = 512


def _keys(x: np.ndarray, size: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, row, position and key of the k-mers at which a row may be found and whose bit is set in the table."""
    order = np.argsort(size, kind="stable")
    every = np.unique(size)
    bits = np.array([_lengths(int(n)) for n in every], np.int64)[np.searchsorted(every, size)]
    start = 0
    while start < len(order):
        rows = order[start : start + BLOCK]
        rows = rows[: max(1, CELLS // int(size[rows[-1]] + 1))]
        start += len(rows)
        n, own = size[rows], bits[rows]
        y = (x[rows, : int(n[-1])] & 31).astype(np.int64)
        g, have = None, 0
        for k in range(1, int(np.bitwise_or.reduce(own)).bit_length()):
            if not (own >> k & 1).any() or k > y.shape[1]:
                continue
            if g is None:
                g = _grams(y, k)
            else:
                for j in range(have, k):
                    g = g[:, :-1] << 5
                    g |= y[:, j:]
            have = k
            # the place of the key, of which only those that are there are made
            hit = _there(table, _bit(g, len(table) * 8, 0, k))
            hit &= np.arange(g.shape[1])[None] <= np.where(own >> k & 1, n - k, -1)[:, None]
            row, pos = np.divmod(np.flatnonzero(hit), g.shape[1])
            yield k, rows[row], pos, _key(g[row, pos], k)


def _own(x: np.ndarray, size: np.ndarray, pr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, length and key of the stretches that the rows probe."""
    need, k = needed(size), stretch_length(size)
    code = _flat(pr.combine_chunks() if isinstance(pr, pa.ChunkedArray) else pr)[0].view("<u2").astype(np.int64)
    row = np.repeat(np.arange(len(size)), need)
    i = np.arange(len(row)) - np.repeat(np.cumsum(need) - need, need)
    pos, length = k[row] * i + (code >> 1), k[row] + (code & 1)
    letters, at, key = (x & 31).ravel(), row * x.shape[1] + pos, np.zeros(len(row), np.int64)
    least = int(length.min(initial=1 << 20)) if len(row) else 0
    for j in range(least):
        key <<= 5
        key |= letters[at + j]
    for j in range(least, int(length.max(initial=0))):
        on = np.flatnonzero(length > j)
        key[on] = key[on] << 5 | letters[at[on] + j]
    return row, pos, length, _key(key, length)


#: Odd factors of the tables of bits, by seed.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0, 0xFF51AFD7ED558CCD)
_MASKS = (128 >> np.arange(8)).astype(np.uint8)


def _bit(key: np.ndarray, bits: int, seed: int, length: int | None = None) -> np.ndarray:
    """The place of a key in a table of so many bits, a power of two: the highest bits of a product. With ``length``, of the key of a k-mer of this length."""
    factor = _FACTORS[seed]
    if length is None:
        out = key.view(np.uint64) * np.uint64(factor)
    else:  # that of 16 times the k-mer and its length
        out = key.view(np.uint64) * np.uint64(16 * factor % (1 << 64))
        out += np.uint64(length * factor % (1 << 64))
    out >>= np.uint64(65 - bits.bit_length())
    return out.view(np.int64)


def _there(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] & _MASKS[bit & 7]) != 0


def _zipped(table: np.ndarray) -> bytes:
    return pa.Codec("zstd", 3).compress(table.tobytes()).to_pybytes()


def _unzipped(data, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, size), np.uint8)


def _gathered(rows: DataFrame, mark, bits: int, twice: bool = False) -> np.ndarray:
    """A table of bits from those of all tasks; its size is fixed. ``mark`` sets them from a task's batches: in one table or, with ``twice``, those seen again in another.

    The tables of tasks meet piece by piece: a bit that two tasks have seen is seen twice.
    """
    piece = bits // 8 // PIECES

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(bits // 8, np.uint8) for _ in range(1 + twice)]
        mark(batches, *tables)
        for k in range(PIECES):
            each = [t[k * piece : (k + 1) * piece] for t in tables]
            if each[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([_zipped(t)], pa.binary()) for t in each]], names=["piece", "one", "two"][: 2 + twice])

    def merge(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [np.zeros(piece, np.uint8) for _ in range(1 + twice)]
        for f in frames:
            for r in f.itertuples(index=False):
                one = _unzipped(r.one, piece)
                if twice:
                    out[1] |= _unzipped(r.two, piece) | (out[0] & one)
                out[0] |= one
        yield pd.DataFrame({"piece": [key[0]], "bits": [_zipped(out[-1])]})

    merge.__annotations__ = {"key": tuple, "frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    schema = "piece int, one binary" + ", two binary" * twice
    table = np.zeros((PIECES, piece), np.uint8)
    for r in rows.mapInArrow(local, schema).groupBy("piece").applyInPandas(merge, "piece int, bits binary").collect():
        table[r["piece"]] = _unzipped(bytes(r["bits"]), piece)
    return table.ravel()


def _packed(context, table: np.ndarray):
    return context.broadcast((_zipped(table), len(table)))


def _set(table: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(table, bit >> 3, _MASKS[bit & 7])


def probed(rows: DataFrame) -> np.ndarray:
    """Bits of the k-mers that any row probes."""

    def mark(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for part, x, size in _together(batches, _of_texts):
            _set(table, _bit(_own(x, size, part.column("pr"))[3], PROBED, 0))

    return _gathered(rows, mark, PROBED)


def shared_keys(rows: DataFrame, table) -> np.ndarray:
    """Bits of the k-mers among those probed that stand in two rows."""

    def mark(batches: Iterator[pa.RecordBatch], one: np.ndarray, two: np.ndarray) -> None:
        known = _unzipped(*table.value)
        for _, x, size in _together(batches, _of_texts):
            seen = [_bit(key, TWICE, 1) << 20 | row for _, row, _, key in _keys(x, size, known)]
            if not seen:
                continue
            seen = np.sort(np.concatenate(seen))
            # of a k-mer that a row has twice, one counts
            bit = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] >> 20
            fresh = np.concatenate([[True], bit[1:] != bit[:-1]])
            _set(two, bit[~fresh])
            bit = bit[fresh]
            _set(two, bit[_there(one, bit)])
            _set(one, bit)

    return _gathered(rows, mark, TWICE, True)


# --- candidates ---------------------------------------------------------------------------------------------------

#: The letters of which a row's composition has the counts, modulo 8.
KINDS = 20
_LOW, _TOP = np.uint64(0x7777777777), np.uint64(0x8888888888)


def composition(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Counts of the letters, each in three bits."""
    out = np.zeros(len(size), np.uint64)
    for g in range(KINDS):
        out |= (np.count_nonzero(x == LETTERS[g + 1], axis=1).astype(np.uint64) & np.uint64(7)) << np.uint64(3 * g)
    return out


def _spread(comp: np.ndarray) -> np.ndarray:
    """The counts with four bits each, ten to a number."""
    out = np.zeros((2, len(comp)), np.uint64)
    for g in range(KINDS):
        out[g // 10] |= (comp >> np.uint64(3 * g) & np.uint64(7)) << np.uint64(4 * (g % 10))
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so much do the counts of two rows differ in sum; all ten counts of a number are worked on at once."""
    out = np.zeros(a.shape[1], np.int64)
    for x, y in zip(a, b, strict=True):
        d = ((x | _TOP) - y) & _LOW
        far = (d & np.uint64(0x4444444444)) >> np.uint64(2)
        far *= np.uint64(7)
        d = (d & ~far) | (_TOP - d & _LOW & far)
        d = (d & np.uint64(0x0707070707)) + (d >> np.uint64(4) & np.uint64(0x0707070707))
        out += ((d * np.uint64(0x0101010101)) >> np.uint64(32) & np.uint64(255)).astype(np.int64)
    return out


FOUND, PROBES, ONLY_PROBES = 0, 1, 2


def _spread_hot(parts: np.ndarray, flag: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the postings, salt and flag. Those of a hot k-mer are spread over a grid: a probe goes to all cells of its line, a row to be found to all of its column."""
    at = np.arange(len(parts))
    own = ids % parts
    cold = at[parts == 1]
    out = [(cold, np.zeros(len(cold), np.int64), flag[cold])]
    for probe in (True, False):
        use = at[(parts > 1) & ((flag > 0) | (not probe))]
        times = parts[use]
        more = np.repeat(use, times)
        step = np.arange(len(more)) - np.repeat(np.cumsum(times) - times, times)
        salt = own[more] * parts[more] + step if probe else step * parts[more] + own[more]
        out.append((more, salt + 1, np.full(len(more), ONLY_PROBES if probe else FOUND)))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def postings(rows: DataFrame, counts, buckets: int) -> DataFrame:
    """The k-mers of each row that it probes or that may be probed, by bucket of their hash: packed arrays, those of a run of rows in one."""
    context = rows.sparkSession.sparkContext
    first = _packed(context, probed(rows))
    second = _packed(context, shared_keys(rows, first))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _unzipped(*first.value), _unzipped(*second.value)
        near, any_hot = counts.value, counts.value.max() > HOT
        edges = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
        for part, x, size in _together(batches, _of_texts):
            ids = part.column("seq_id").to_numpy().astype(np.int64)
            # rows in the order of their ids: differences are small
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            comp = composition(x, size)
            row, pos, length, own = _own(x, size, part.column("pr"))
            mine = np.zeros(x.shape, np.uint8)
            mine[row, pos] = length
            packed, sixes = [], _grams(x, K) if any_hot else None
            for k, row, pos, key in _keys(x, size, one):
                use = np.nonzero(_there(two, _bit(key, TWICE, 1)))[0]
                row, pos, key = row[use], pos[use], key[use]
                probe = mine[row, pos] == k
                at, salt, flag = np.arange(len(key)), np.zeros(len(key), np.int64), probe.astype(np.int64)
                if any_hot and k >= K:
                    # a stretch stands in as many rows as the rarest k-mer in it, at most
                    often = np.min([near[_slot(sixes[row, pos + j])] for j in range(k - K + 1)], axis=0)
                    at, salt, flag = _spread_hot(often.astype(np.int64) // HOT + 1, flag, ids[row])
                g = _mix(_mix(key[at]) + (salt.astype(np.uint64) << np.uint64(1))) >> np.uint64(32)
                packed.append(g << np.uint64(22) | rank[row[at]].astype(np.uint64) << np.uint64(2) | flag.astype(np.uint64))
            z = np.sort(np.concatenate(packed)) if packed else np.zeros(0, np.uint64)
            cuts = np.searchsorted(z >> np.uint64(22), edges)
            for b in range(buckets):
                p = z[cuts[b] : cuts[b + 1]]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_blob(p, ids[order], comp[order], size[order])], pa.binary())], names=["bucket", "data"])

    return rows.mapInArrow(make, "bucket int, data binary")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the same weight together, which is easier to compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _sixes(comp: np.ndarray) -> bytes:
    """The counts of two letters to a byte, those of the same letters together, which is easier to compress."""
    return np.stack([(comp >> np.uint64(6 * k)).astype(np.uint8) & np.uint8(63) for k in range(KINDS // 2)]).tobytes()


def _of_sixes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(raw.shape[1], np.uint64)
    for k, x in enumerate(raw):
        out |= x.astype(np.uint64) << np.uint64(6 * k)
    return out


def _blob(p: np.ndarray, ids: np.ndarray, comp: np.ndarray, size: np.ndarray) -> bytes:
    row = (p >> np.uint64(2) & np.uint64((1 << 20) - 1)).astype(np.int64)
    there = np.zeros(len(ids), bool)
    there[row] = True
    local = (np.cumsum(there) - 1)[row]
    g = (p >> np.uint64(22)).astype(np.uint32)
    own = np.diff(ids[there], prepend=0)
    data = b"".join([_planes(np.diff(g, prepend=np.uint32(0))), _planes((local << 2 | (p & np.uint64(3)).astype(np.int64)).astype(np.uint32)), _planes(own), _sixes(comp[there]), _planes(size[there].astype(np.uint32))])
    return np.array([len(g), len(own), len(data)], np.int64).tobytes() + pa.Codec("zstd", 1).compress(data).to_pybytes()


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, row with flag, and of the rows: id, composition and length."""
    n, m, size = np.frombuffer(blob[:24], np.int64)
    data = pa.Codec("zstd").decompress(blob[24:], int(size))
    at = 0

    def take(count: int, kind) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(data, np.uint8, count * width, at)
        at += count * width
        return np.ascontiguousarray(raw.reshape(width, count).T).view(kind).ravel()

    g, row, ids = take(int(n), np.uint32), take(int(n), np.uint32), take(int(m), np.int64)
    comp = _of_sixes(np.frombuffer(data, np.uint8, KINDS // 2 * int(m), at).reshape(KINDS // 2, int(m)))
    at += KINDS // 2 * int(m)
    length = take(int(m), np.uint32)
    return np.cumsum(g, dtype=np.uint32), row, np.cumsum(ids), comp, length.astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], block: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Pairs of a probe and a row of its group whose counts of letters allow it. A task has one bucket, whose size is bounded."""
    parts: list[tuple[np.ndarray, ...]] = []
    base = 0
    for batch in batches:
        for blob in batch.column("data"):
            g, row, ids, comp, length = _unblob(blob.as_py())
            parts.append((g, (row >> 2).astype(np.int64) + base, (row & 3).astype(np.int8), ids, comp, length))
            base += len(ids)
    if not parts:
        return
    g, row, flag, ids, comp, length = (np.concatenate(z) for z in zip(*parts, strict=True))
    # rows by the rank of their id: those of one id compare as equal
    each, ids = np.unique(ids, return_inverse=True)
    comp = _spread(comp)
    order = np.argsort(g, kind="stable")
    g, row, flag = g[order], row[order].astype(np.int32), flag[order]
    start = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0]
    size = np.diff(np.concatenate([start, [len(g)]]))
    first, times = np.repeat(start, size), np.repeat(size, size)
    p = np.nonzero((flag > 0) & (times > 1))[0]
    first, times = first[p], times[p]
    ends = np.concatenate([[0], np.cumsum(times)])
    # of postings: the length of their row, and the least length that it may meet; a row that only probes is met by none
    long = length[row].astype(np.int32)
    least = long - budget(long)
    met = np.where(flag < ONLY_PROBES, long, -1)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + block, "right")) - 1)
        t = times[lo:hi]
        left = np.repeat(p[lo:hi].astype(np.int32), t)
        right = np.repeat((first[lo:hi] - (ends[lo:hi] - ends[lo])).astype(np.int32), t) + np.arange(int(t.sum()), dtype=np.int32)
        lo = hi
        # the longer row probes; two probes of a length meet twice: once is enough
        z = met[right]
        ok = np.flatnonzero((z <= long[left]) & (z >= least[left]) & (z >= 0))
        left, right = left[ok], right[ok]
        la, lb, fr, left, right = long[left], long[right], flag[right], row[left], row[right]
        a, b = ids[left], ids[right]
        ok = np.flatnonzero((a != b) & ((la > lb) | (fr == FOUND) | (a < b)))
        left, right, a, b, la, lb = (z[ok] for z in (left, right, a, b, la, lb))
        # an edit moves two counts by one at most, and only one count if it changes the length
        ok = apart(comp[:, left], comp[:, right]) <= 2 * budget(la) - (la - lb)
        a, b = np.divmod(np.unique(np.minimum(a[ok], b[ok]) * len(each) + np.maximum(a[ok], b[ok])), len(each))
        yield pa.RecordBatch.from_arrays([pa.array(each[a]), pa.array(each[b])], names=["a", "b"])


#: Bits of the table of rows that are in any candidate.
WANTED = 1 << 24


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with five bits a letter."""
    for part, x, size in _together(batches, _of_texts):
        bits = np.unpackbits((x & 31)[:, :, None], axis=2)[:, :, 3:].reshape(len(size), -1)
        full = np.packbits(bits, axis=1)
        width = (5 * size + 7) // 8
        data = full[np.arange(full.shape[1])[None] < width[:, None]]
        ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([part.column("seq_id").combine_chunks(), pa.array(size.astype(np.int32)), text], names=["seq_id", "n", "z"])


def unpacked(z: pd.Series, n: pd.Series) -> pd.Series:
    """The texts again; a sign that is no letter comes out as another that is none."""
    code, each = pd.factorize(z.to_numpy(object))
    size = np.zeros(len(each), np.int64)
    size[code] = n.to_numpy()
    out = np.empty(len(each), object)
    for run in by_length(size):
        raw = [bytes(each[k]) for k in run]
        x = padded(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
        bits = np.unpackbits(x, axis=1)
        width = bits.shape[1] // 5
        letters = (bits[:, : 5 * width].reshape(len(run), width, 5) @ np.array([16, 8, 4, 2, 1], np.uint8)) + np.uint8(64)
        flat = letters.tobytes().decode("latin-1")
        for r, k in enumerate(run):
            out[k] = flat[r * width : r * width + size[k]]
    return pd.Series(out[code], dtype=object)


def near_pairs(reps: DataFrame, counts) -> DataFrame:
    """All pairs of near duplicates among ``reps`` (seq_id, s, pr), whose texts differ: a, b with a < b."""
    spark = reps.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, reps.count() * 20 // POSTINGS)
    found = postings(reps.select("seq_id", "s", "pr"), counts, buckets).repartitionById(buckets, "bucket").mapInArrow(_pairs, "a long, b long")
    found = stored(found.repartition("a").dropDuplicates(["a", "b"]))

    def mark(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in batches:
            for side in batch.columns:
                _set(table, _bit(side.to_numpy(), WANTED, 3))

    wanted = _packed(spark.sparkContext, _gathered(found, mark, WANTED))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unzipped(*wanted.value)
        for batch in batches:
            yield batch.filter(pa.array(_there(bits, _bit(batch.column("seq_id").to_numpy(), WANTED, 3))))

    own = reps.select("seq_id", "s").mapInArrow(lambda b: _packed_texts(some(b)), "seq_id long, n int, z binary")
    texts = found.join(own.toDF("a", "na", "za"), "a").join(own.toDF("b", "nb", "zb"), "b")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the few pairs that need a search for a move are searched together
        waiting: list[pd.DataFrame] = []
        rows = letters = 0

        def verified() -> pd.DataFrame:
            f = pd.concat(waiting, ignore_index=True)
            ok = verify(unpacked(f["za"], f["na"]), unpacked(f["zb"], f["nb"]))
            return f.loc[ok, ["a", "b"]]

        for f in frames:
            waiting.append(f)
            rows, letters = rows + len(f), letters + int(f["na"].sum() + f["nb"].sum())
            if rows >= TOGETHER or letters >= LETTERS_TOGETHER:
                yield verified()
                waiting, rows, letters = [], 0, 0
        if waiting:
            yield verified()

    # of a row that was delivered twice alike both stand in the table
    return texts.mapInPandas(check, "a long, b long").dropDuplicates(["a", "b"])


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def near_duplicates(rows: DataFrame, key: str = "seq_id", states: str = "states", loaded: str = "loaded_at") -> dict[str, DataFrame]:
    """Near duplicates of alignment rows.

    Of the deliveries of a key the last counts, of equally late ones the one
    whose text has the greatest hash. Equal texts make a class, and only its
    least key is compared with others. Result: ``members`` (key, class) for
    all rows with residues; ``links`` (a, b), the pairs of classes; ``copies``
    (key, class, n) for the classes of several rows, n being their number.
    Rows that are null or hold no residue are in none; null keys are left
    out; a null state counts as a gap, a state out of range as a residue of
    its own. Texts too short for an edit (under 10 residues) are near
    duplicates only by a move. Columns other than the three named are not
    used. Empty tables give empty results.
    """
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.sparkSession.sparkContext.broadcast(frequent_counts(rows, states))
    texts = text_table(rows, key, states, loaded, counts)
    # keys that came several times, and what counts of them: few, as a rule
    again = checkpoint(texts.groupBy("seq_id").agg(F.count("*").alias("c")).where("c > 1").select("seq_id"))
    last = texts.join(_if_small(again), "seq_id").groupBy("seq_id").agg(F.max(F.struct("loaded", "h", "h2")).alias("m"))
    last = checkpoint(last.select("seq_id", F.col("m.h").alias("mh"), F.col("m.h2").alias("mh2")))
    live = texts.join(_if_small(last), "seq_id", "left").where("s <> '' and (mh is null or (mh = h and mh2 = h2))")
    ids = live.select("seq_id", "h", "h2")
    classes = ids.groupBy("h", "h2").agg(F.min("seq_id").alias("class"), F.max("seq_id").alias("other")).where("class <> other").select("h", "h2", "class")
    classes = checkpoint(classes)
    copies = ids.join(_if_small(classes), ["h", "h2"]).select("seq_id", "class").distinct()
    copies = checkpoint(copies.join(copies.groupBy("class").agg(F.count("*").alias("n")), "class").select("seq_id", "class", "n"))
    others = copies.where("seq_id <> class").select("seq_id")
    reps = live.join(_if_small(others), "seq_id", "left_anti")
    members = ids.select("seq_id").distinct().join(copies.select("seq_id", "class"), "seq_id", "left")
    return {
        "members": members.select("seq_id", F.coalesce("class", "seq_id").alias("class")),
        "links": near_pairs(reps, counts),
        "copies": copies,
    }


#: Rows of a class that are paired with the rest of it in one go.
PART = 1_000


def all_pairs(found: dict[str, DataFrame]) -> DataFrame:
    """The pairs of rows: links between classes for each of their rows, and the pairs within a class, a large one in parts."""
    copies = found["copies"]
    links = found["links"]
    for side in ("a", "b"):
        own = copies.select(F.col("class").alias(side), F.col("seq_id").alias(f"_{side}"))
        links = links.join(own, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    between = links.select(F.least("_a", "_b").alias("seq_id_a"), F.greatest("_a", "_b").alias("seq_id_b"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    x = copies.select(F.col("seq_id").alias("seq_id_a"), "class", F.pmod(F.xxhash64("seq_id"), parts).cast("int").alias("part"))
    y = copies.select(F.col("seq_id").alias("seq_id_b"), "class", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    within = x.join(y, ["class", "part"]).where("seq_id_a < seq_id_b").select("seq_id_a", "seq_id_b")
    return between.unionByName(within)
