"""One-, two- and three-column frequencies of alignments, and what is derived from them.

Counts of column pairs come from products of one-hot matrices within tasks:
rows are spread by group and salt, so that a task holds one group at a time
and a group with a third of all rows is worked on by many tasks; what is
shuffled are counts, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.alignment import Q, long

#: Rows of a group that one task takes.
ROWS_A_TASK = 100_000
#: Groups up to which a table with a row for each is broadcast.
MOST_BROADCAST = 1_000_000


def single_counts(rows: DataFrame, group: str = "family", states: str = "states", weight: str | None = None) -> DataFrame:
    """group, pos, state, n: the (weighted) number of rows with a state at a column."""
    keep = [group] + ([weight] if weight else [])
    n = F.sum(weight) if weight else F.count("*")
    return long(rows, *keep, states=states).groupBy(group, "pos", "state").agg(n.alias("n"))


def _one_hot(x: np.ndarray) -> np.ndarray:
    n, width = x.shape
    out = np.zeros((n, width * Q), np.float32)
    out[np.arange(n)[:, None], np.arange(width)[None] * Q + x] = 1
    return out


def _weighted(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weighted product of one-hot rows with themselves; rows of the most frequent weight are counted as whole numbers, which single precision holds."""
    value, n = np.unique(w, return_counts=True)
    most = w == value[n.argmax()]
    same, rest = h[most], h[~most].astype(np.float64)
    out = (same.T @ same).astype(np.float64) * value[n.argmax()] if len(same) else 0.0
    return out + (rest * w[~most][:, None]).T @ rest if len(rest) else out


def _of_group(rows: DataFrame, group: str, rows_a_task: int) -> tuple[DataFrame, int]:
    """The number of salts of each group, and the largest; broadcast where there are few groups."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / rows_a_task).cast("int").alias("_salts"))
    r = sizes.agg(F.count("*").alias("n"), F.max("_salts").alias("m")).first()
    return (F.broadcast(sizes) if r["n"] <= MOST_BROADCAST else sizes), r["m"] or 1


def pair_blocks(
    rows: DataFrame,
    make: Callable[[str, int, np.ndarray], pd.DataFrame],
    schema: str,
    group: str = "family",
    key: str = "seq_id",
    states: str = "states",
    weight: str | None = None,
    rows_a_task: int | None = None,
) -> DataFrame:
    """What ``make(group, i, n)`` returns for each first column; ``n[j - i - 1, a, b]`` has the (weighted) rows with a at column i and b at column j > i.

    All columns and all 441 cells are counted. Rows of a group must be of one
    length; states null or out of range count as gaps, null states as none.
    A large group is cut into salts, as many as its own rows need, whose
    counts are then summed, one first column of a group at a time. ``make``
    gets no column without another behind it.
    """
    sizes, salts = _of_group(rows, group, rows_a_task or ROWS_A_TASK)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    spread = rows.where(F.col(states).isNotNull()).join(sizes, group).select(group, F.pmod(F.xxhash64(key), F.col("_salts")).cast("int").alias("salt"), F.col(states).cast("array<tinyint>").alias("_s"), w.alias("_w"))
    spread = spread.repartition(group, "salt").sortWithinPartitions(group)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
        at, acc = None, None
        for f in frames:
            for g, mine in f.groupby(group, sort=False):
                if g != at and at is not None:
                    yield at, acc
                    acc = None
                at = g
                for k in range(0, len(mine), 4096):
                    some = mine.iloc[k : k + 4096]
                    x = np.stack([np.nan_to_num(np.asarray(s, np.float32)) for s in some["_s"]]).astype(np.int64)
                    h = _one_hot(np.where((x < 0) | (x >= Q), 0, x))
                    if weight:
                        part = _weighted(h, some["_w"].to_numpy())
                    else:
                        part = h.T @ h
                    acc = part.astype(np.float64) if acc is None else acc + part
        if at is not None:
            yield at, acc

    def columns(total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        width = total.shape[0] // Q
        cube = total.reshape(width, Q, width, Q)
        for i in range(width - 1):
            yield i, np.ascontiguousarray(cube[i, :, i + 1 :].transpose(1, 0, 2))

    if salts == 1:

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g, total in grams(frames):
                for i, n in columns(total):
                    yield make(g, i, n)

        return spread.mapInPandas(whole, schema)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, total in grams(frames):
            for i, n in columns(total):
                yield pd.DataFrame({group: [g], "i": np.int32(i), "n": [n.astype("<f8").tobytes()]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for x in f["n"]:
                n = np.frombuffer(x, "<f8")
                total = n.copy() if total is None else total + n
        yield make(key[0], int(key[1]), total.reshape(-1, Q, Q))

    add.__annotations__ = {"key": tuple, "frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return spread.mapInPandas(parts, f"{group} string, i int, n binary").groupBy(group, "i").applyInPandas(add, schema)


def by_pair(rows: DataFrame, values: Callable[[np.ndarray, str], dict[str, np.ndarray]], columns: str, **options) -> DataFrame:
    """group, i, j and ``columns``: what ``values(n, group)`` returns for each pair of columns."""
    group = options.get("group", "family")

    def make(g: str, i: int, n: np.ndarray) -> pd.DataFrame:
        j = np.arange(i + 1, i + 1 + len(n), dtype=np.int32)
        return pd.DataFrame({group: np.full(len(j), g, object), "i": np.int32(i), "j": j} | values(n, g))

    return pair_blocks(rows, make, f"{group} string, i int, j int, {columns}", **options)


# what follows works on stacked count blocks n[pair, a, b]; the marginals are sums of the pair counts themselves


def shares(n: np.ndarray, _: str = "") -> np.ndarray:
    return n / n.sum(axis=(1, 2), keepdims=True)


def correlation(n: np.ndarray, _: str = "") -> np.ndarray:
    """``fij - fi fj`` of all cells."""
    p = shares(n)
    return p - p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True)


def strength(n: np.ndarray, _: str = "") -> np.ndarray:
    c = correlation(n)
    return np.sqrt((c * c).sum(axis=(1, 2)))


def with_pair_pseudocount(n: np.ndarray, _: str = "") -> np.ndarray:
    """Pair frequencies ``(1 - a) fij + a / q**2`` with ``a = 1 / total``; their marginals are the single ones with their pseudocount."""
    a = 1 / n.sum(axis=(1, 2), keepdims=True)
    return (1 - a) * shares(n) + a / (Q * Q)


def log_odds(n: np.ndarray, _: str = "") -> np.ndarray:
    """Couplings of pairs taken by themselves: the logarithm of ``fij / (fi fj)``, pseudocounts in all three."""
    p = with_pair_pseudocount(n)
    return np.log(p) - np.log(p.sum(axis=2, keepdims=True)) - np.log(p.sum(axis=1, keepdims=True))


def centred(v: np.ndarray) -> np.ndarray:
    """Blocks in the zero-sum gauge."""
    return v - v.mean(axis=2, keepdims=True) - v.mean(axis=1, keepdims=True) + v.mean(axis=(1, 2), keepdims=True)


def block_strength(rows: DataFrame, group: str = "family", key: str = "seq_id", states: str = "states", rows_a_task: int | None = None, weight: str | None = None) -> DataFrame:
    """group, i, j (i < j) and the Frobenius norm of the (weighted) correlations of two columns, over all 441 cells, absent ones included."""
    return by_pair(rows, lambda n, _: {"strength": strength(n)}, "strength double", group=group, key=key, states=states, weight=weight, rows_a_task=rows_a_task)


def gauge_shifts(rows: DataFrame, values: Callable[[np.ndarray, str], np.ndarray], group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """group, pos, state, x: what the zero-sum gauge moves from all blocks of couplings to the fields of either column."""

    def make(g: str, i: int, n: np.ndarray) -> pd.DataFrame:
        v = values(n, g)
        all_ = v.mean(axis=(1, 2))[:, None]
        own, others = (v.mean(axis=2) - all_).sum(axis=0)[None], v.mean(axis=1) - all_
        pos = np.arange(i, i + 1 + len(n), dtype=np.int32)
        return pd.DataFrame({group: np.full(len(pos), g, object), "pos": pos, "x": list(np.concatenate([own, others]))})

    parts = pair_blocks(rows, make, f"{group} string, pos int, x array<double>", group=group, key=key, states=states)
    total = parts.groupBy(group, "pos").agg(F.array(*[F.sum(F.col("x")[k]) for k in range(Q)]).alias("x"))
    return total.select(group, "pos", F.posexplode("x").alias("state", "x"))


#: Steps in which the sizes of cells are counted: so many for each halving.
STEPS, MOST_STEP = 64, 2_047


def _size(v: np.ndarray) -> np.ndarray:
    return np.round(np.abs(v) * 1e9).astype(np.int64)


def _step(v: np.ndarray) -> np.ndarray:
    """Sizes in steps, the largest first."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.floor((30 - np.log2(_size(v))).clip(0, 40) * STEPS), MOST_STEP).astype(np.int64)


def _edges(rows: DataFrame, values: Callable[[np.ndarray, str], np.ndarray], pct: float, group: str, key: str, states: str) -> dict[str, tuple[int, int, int]]:
    """Where a mask of ``pct`` percent ends in each group: the least size kept, the first column in which cells of that size run out, and how many of them are kept there.

    Sizes are absolute values in units of the ninth digit. They are counted
    in steps first, then one by one within the step in which the number is
    reached; a row for each group comes to the driver.
    """
    options = {"group": group, "key": key, "states": states}

    def count(g: str, i: int, n: np.ndarray) -> pd.DataFrame:
        v = values(n, g)
        c = np.bincount(_step(v)[_size(v) > 0])
        at = np.nonzero(c)[0]
        return pd.DataFrame({group: np.full(len(at), g, object), "s": at.astype(np.int32), "n": c[at]})

    steps = pair_blocks(rows, count, f"{group} string, s int, n long", **options).groupBy(group, "s").agg(F.sum("n").alias("n"))
    widths = rows.groupBy(group).agg(F.max(F.size(states)).alias("_l"))
    k = F.floor(F.col("_l") * F.col("_l") * F.lit(Q * Q / 2 * (1 - pct / 100)) + 1e-9)
    before = lambda *by: F.sum("n").over(Window.partitionBy(group).orderBy(*by)) - F.col("n")
    reached = steps.withColumn("_before", before("s")).join(widths, group).withColumn("_k", k).where("_before < _k and _before + n >= _k")
    step = {r[0]: (r[1], r[2]) for r in reached.select(group, "s", F.col("_k") - F.col("_before")).collect()}

    def within(g: str, i: int, n: np.ndarray) -> pd.DataFrame:
        v = values(n, g)
        size = _size(v)
        at, c = np.unique(size[(size > 0) & (_step(v) == step[g][0])] if g in step else size[:0], return_counts=True)
        return pd.DataFrame({group: np.full(len(at), g, object), "i": np.int32(i), "size": at, "n": c})

    sizes = pair_blocks(rows, within, f"{group} string, i int, size long, n long", **options)
    left = rows.sparkSession.createDataFrame([(g, x[1]) for g, x in step.items()], f"{group} string, _k long")
    # by size, then by column: the first place at which enough are counted
    reached = sizes.withColumn("_before", before(F.desc("size"), "i")).join(left, group).where("_before < _k and _before + n >= _k")
    return {r[0]: (r[1], r[2], r[3]) for r in reached.select(group, "size", "i", F.col("_k") - F.col("_before")).collect()}


def _kept(v: np.ndarray, edge: tuple[int, int, int] | None, i: int) -> np.ndarray:
    """Which cells of the blocks of a first column are kept; without an edge all that are not 0."""
    size = _size(v)
    if edge is None:
        return size > 0
    out = size > edge[0]
    if i <= edge[1]:
        ties = np.nonzero((size == edge[0]).ravel())[0]
        more = np.zeros(size.size, bool)
        more[ties if i < edge[1] else ties[: edge[2]]] = True
        out |= more.reshape(size.shape)
    return out


def kept_cells(rows: DataFrame, values: Callable[[np.ndarray, str], np.ndarray], pct: float, group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """group, i, j, a, b, v of the cells that a mask of ``pct`` percent keeps: the largest of the upper triangle by absolute value, over all columns.

    As many are kept as ``int(n**2 * 21**2 / 2 * (1 - pct / 100))``, ties by
    the cells' order, but none that is 0 to nine digits. At 100 percent none
    is kept, and nothing is counted.
    """
    schema = f"{group} string, i int, j int, a int, b int, v double"
    if pct >= 100:
        return rows.sparkSession.createDataFrame([], schema)
    edges = _edges(rows, values, pct, group, key, states)

    def pick(g: str, i: int, n: np.ndarray) -> pd.DataFrame:
        v = values(n, g)
        j, a, b = np.nonzero(_kept(v, edges.get(g), i))
        return pd.DataFrame({group: np.full(len(j), g, object), "i": np.int32(i), "j": (j + i + 1).astype(np.int32), "a": a.astype(np.int32), "b": b.astype(np.int32), "v": v[j, a, b]})

    return pair_blocks(rows, pick, schema, group=group, key=key, states=states)


def kept_by_pair(rows: DataFrame, values: Callable[[np.ndarray, str], np.ndarray], pct: float, group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """group, i, j, n_kept and code_sum: of the cells that ``kept_cells`` keeps at each two columns, the number and the sum of ``21 a + b``."""
    edges = _edges(rows, values, pct, group, key, states)
    code = np.arange(Q * Q).reshape(Q, Q)

    def digest(g: str, i: int, n: np.ndarray) -> pd.DataFrame:
        keep = _kept(values(n, g), edges.get(g), i)
        j = np.arange(i + 1, i + 1 + len(n), dtype=np.int32)
        return pd.DataFrame({group: np.full(len(j), g, object), "i": np.int32(i), "j": j, "n_kept": keep.sum(axis=(1, 2)), "code_sum": (keep * code).sum(axis=(1, 2))})

    return pair_blocks(rows, digest, f"{group} string, i int, j int, n_kept long, code_sum long", group=group, key=key, states=states).where("n_kept > 0")


def frequencies(counts: DataFrame, totals: DataFrame, group: str = "family") -> DataFrame:
    """Counts with ``f``: their share of the group's total ``total``."""
    return counts.join(totals, group).withColumn("f", F.col("n") / F.col("total")).drop("total")


def with_pseudocount(single: DataFrame, totals: DataFrame, lengths: DataFrame, group: str = "family") -> DataFrame:
    """Dense single frequencies ``(1 - a) f + a / q`` with ``a = 1 / total``; ``lengths`` has n_cols by group."""
    cells = lengths.select(group, F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("pos")).select(
        group, "pos", F.explode(F.sequence(F.lit(0), F.lit(Q - 1))).alias("state")
    )
    alpha = 1 / F.col("total")
    f = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    dense = cells.join(single, [group, "pos", "state"], "left").join(totals, group)
    return dense.select(group, "pos", "state", ((1 - alpha) * f + alpha / Q).alias("f"))


def variable_columns(single: DataFrame, k: int = 10, group: str = "family") -> DataFrame:
    """The ``k`` columns of each group with the most even states: least sum of squared counts per squared total, ties by column."""
    s = single.groupBy(group, "pos").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("purity"))
    w = Window.partitionBy(group).orderBy(F.round("purity", 9), "pos")
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(group, "pos")


def at_columns(rows: DataFrame, columns: DataFrame, group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """Long rows of the chosen columns only; the arrays are filtered before they are exploded."""
    chosen = columns.groupBy(group).agg(F.sort_array(F.collect_list("pos")).alias("cols"))
    cell = F.transform("cols", lambda c: F.struct(c.alias("pos"), F.coalesce(F.get(F.col(states), c), F.lit(0)).alias("state")))
    return rows.join(chosen, group).select(group, key, F.inline(cell))


def column_tuples(rows: DataFrame, columns: DataFrame, order: int, group: str = "family", states: str = "states") -> DataFrame:
    """Counts of states at each pair (order 2) or triple (order 3) of the chosen columns, expanded within the row."""
    chosen = columns.groupBy(group).agg(F.sort_array(F.collect_list("pos")).alias("cols"))
    cells = F.transform("cols", lambda c: F.struct(c.alias("p"), F.coalesce(F.get(F.col(states), c), F.lit(0)).alias("s")))
    x = rows.join(chosen, group).select(group, cells.alias("c"))
    names = [("i", "a"), ("j", "b"), ("k", "c")][:order]
    for n, (p, s) in enumerate(names):
        keep = [group, "c", *[v for q in names[:n] for v in q]]
        x = x.select(*keep, F.inline("c")).withColumnRenamed("p", f"_{p}").withColumnRenamed("s", f"_{s}")
        if n:
            x = x.where(F.col(names[n - 1][0]) < F.col(f"_{p}"))
        x = x.withColumnRenamed(f"_{p}", p).withColumnRenamed(f"_{s}", f"{s}" if s != "c" else "cc")
    flat = [v if v != "c" else "cc" for q in names for v in q]
    return x.groupBy(group, *flat).agg(F.count("*").alias("n"))


def pair_correlations(pairs: DataFrame, single: DataFrame, totals: DataFrame, group: str = "family") -> DataFrame:
    """``fij - fi fj`` for every cell of the chosen column pairs, absent ones included."""
    f = frequencies(single, totals, group).select(group, "pos", "state", "f")
    a = f.select(group, F.col("pos").alias("i"), F.col("state").alias("a"), F.col("f").alias("fa"))
    b = f.select(group, F.col("pos").alias("j"), F.col("state").alias("b"), F.col("f").alias("fb"))
    cells = a.join(b, group).where("i < j")
    p = frequencies(pairs, totals, group).select(group, "i", "a", "j", "b", F.col("f").alias("fij"))
    c = F.coalesce("fij", F.lit(0.0)) - F.col("fa") * F.col("fb")
    return cells.join(p, [group, "i", "a", "j", "b"], "left").select(group, "i", "j", "a", "b", c.alias("c"))


def triple_correlations(triples: DataFrame, pairs: DataFrame, single: DataFrame, totals: DataFrame, group: str = "family") -> DataFrame:
    """``fijk - fij fk - fik fj - fjk fi + 2 fi fj fk`` of the state triples that occur."""
    f1 = frequencies(single, totals, group).select(group, "pos", "state", "f")
    f2 = frequencies(pairs, totals, group).select(group, "i", "a", "j", "b", "f")
    t = frequencies(triples, totals, group).withColumnRenamed("f", "fijk").drop("n")
    for p, s in (("i", "a"), ("j", "b"), ("k", "cc")):
        t = t.join(f1.select(group, F.col("pos").alias(p), F.col("state").alias(s), F.col("f").alias(f"f{p}")), [group, p, s])
    for (p, s), (q, r) in ((("i", "a"), ("j", "b")), (("i", "a"), ("k", "cc")), (("j", "b"), ("k", "cc"))):
        t = t.join(f2.select(group, F.col("i").alias(p), F.col("a").alias(s), F.col("j").alias(q), F.col("b").alias(r), F.col("f").alias(f"f{p}{q}")), [group, p, s, q, r])
    c = F.col("fijk") - F.col("fij") * F.col("fk") - F.col("fik") * F.col("fj") - F.col("fjk") * F.col("fi") + 2 * F.col("fi") * F.col("fj") * F.col("fk")
    return t.select(group, "i", "j", "k", "a", "b", F.col("cc").alias("c"), c.alias("c3"))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero; a little above half a digit counts as half, whatever the order in which a sum was taken."""
    return F.round(x + 1e-10, digits) + 0.0
