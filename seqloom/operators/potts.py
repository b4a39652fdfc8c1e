"""Parameter tables of pairwise models: fields ``h(group, pos, state, v)`` and couplings ``J(group, i, j, a, b, v)`` with i < j."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.alignment import Q, long
from seqloom.operators.frequencies import _of_group, pair_blocks

#: Fixed: background frequencies of the residues, in the order of states 1 to 20.
BACKGROUND = (
    0.073, 0.025, 0.050, 0.061, 0.042, 0.072, 0.023, 0.053, 0.064, 0.089,
    0.023, 0.043, 0.052, 0.040, 0.052, 0.073, 0.056, 0.063, 0.013, 0.033,
)


def profile_fields(frequencies: DataFrame, group: str = "family") -> DataFrame:
    """Fields of the independent model: the logarithm of dense frequencies."""
    return frequencies.select(group, "pos", "state", F.log("f").alias("v"))


def field_offset(pos: str = "pos", state: str = "state", width: str = "width"):
    """Where a field lies in the packed parameter vector: behind all coupling blocks."""
    half = F.col(width) * (F.col(width) - 1) / 2
    return (half.cast("long") * Q * Q + F.col(pos) * Q + F.col(state)).cast("long")


def coupling_offset(width: str = "width"):
    """Where a coupling with i < j lies in the packed parameter vector."""
    i, j = F.col("i"), F.col("j")
    block = (i * (2 * F.col(width) - i - 1) / 2).cast("long") + j - i - 1
    return (block * Q * Q + F.col("a") * Q + F.col("b")).cast("long")


def pack(fields: DataFrame, couplings: DataFrame, widths: DataFrame, group: str = "family") -> DataFrame:
    """group, offset, v of the packed vector; ``widths`` has width by group."""
    h = fields.join(widths, group).select(group, field_offset().alias("offset"), "v")
    return couplings.join(widths, group).select(group, coupling_offset().alias("offset"), "v").unionByName(h)


def unpack(packed: DataFrame, widths: DataFrame, group: str = "family") -> tuple[DataFrame, DataFrame]:
    """Fields and couplings of a packed vector."""
    x = packed.join(widths, group)
    n = F.col("width")
    split = (n * (n - 1) / 2).cast("long") * Q * Q
    x = x.withColumn("_o", F.col("offset") - split)
    h = x.where("_o >= 0").select(group, F.floor(F.col("_o") / Q).cast("int").alias("pos"), F.pmod("_o", F.lit(Q)).cast("int").alias("state"), "v")
    block = F.floor(F.col("offset") / (Q * Q))
    # i is the largest whose first block is not behind this one
    root = F.floor((2 * n - 1 - F.sqrt(F.pow(2 * n - 1, F.lit(2.0)) - 8 * block)) / 2)
    start = lambda i: i * (2 * n - i - 1) / 2
    i = F.when(start(root + 1) <= block, root + 1).otherwise(root)
    c = x.where("_o < 0").withColumns({"_block": block, "i": i.cast("int")})
    j = F.col("_block") - start(F.col("i")) + F.col("i") + 1
    cell = F.pmod("offset", F.lit(Q * Q))
    c = c.select(group, "i", j.cast("int").alias("j"), F.floor(cell / Q).cast("int").alias("a"), F.pmod(cell, F.lit(Q)).cast("int").alias("b"), "v")
    return h, c


def zero_sum_gauge(fields: DataFrame, couplings: DataFrame, group: str = "family") -> tuple[DataFrame, DataFrame]:
    """Fields and couplings (dense) whose sums over each state are zero, and which give the same energies but for a constant."""
    mean = lambda *by: F.avg("v").over(Window.partitionBy(group, "i", "j", *by))
    m = couplings.withColumns({"_b": mean("b"), "_a": mean("a"), "_m": mean()})
    j = m.select(group, "i", "j", "a", "b", (F.col("v") - F.col("_a") - F.col("_b") + F.col("_m")).alias("v"))
    # what a block's rows and columns hold goes to the fields of either column
    to_i = m.groupBy(group, F.col("i").alias("pos"), "j", F.col("a").alias("state")).agg(F.first("_a").alias("x"), F.first("_m").alias("y"))
    to_j = m.groupBy(group, F.col("j").alias("pos"), "i", F.col("b").alias("state")).agg(F.first("_b").alias("x"), F.first("_m").alias("y"))
    moved = to_i.select(group, "pos", "state", "x", "y").unionByName(to_j.select(group, "pos", "state", "x", "y"))
    moved = moved.groupBy(group, "pos", "state").agg(F.sum(F.col("x") - F.col("y")).alias("x"))
    own = F.col("v") - F.avg("v").over(Window.partitionBy(group, "pos"))
    h = fields.select(group, "pos", "state", own.alias("v")).join(moved, [group, "pos", "state"], "left")
    return h.select(group, "pos", "state", (F.col("v") + F.coalesce("x", F.lit(0.0))).alias("v")), j


def block_norms(couplings: DataFrame, group: str = "family") -> DataFrame:
    """The Frobenius norm of each block."""
    return couplings.groupBy(group, "i", "j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def mean_norm(couplings: DataFrame, widths: DataFrame, group: str = "family") -> DataFrame:
    """The training record: the mean norm over all ordered pairs of columns, the zero diagonal included, to 3 digits."""
    n = block_norms(couplings, group).groupBy(group).agg(F.sum("norm").alias("s"))
    return n.join(widths, group).select(group, F.round(2 * F.col("s") / (F.col("width") * F.col("width")), 3).alias("j_norm"))


def energies(rows: DataFrame, fields: DataFrame, couplings: DataFrame | None = None, group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """group, key, energy: minus the fields and, for i < j, the couplings of the row's states. Cells that the tables lack count 0."""
    x = long(rows, group, key, states=states)
    parts = x.join(fields, [group, "pos", "state"]).select(group, key, "v")
    if couplings is not None:
        cols = couplings.select(group, "i", "j").distinct().groupBy(group).agg(F.collect_list(F.struct("i", "j")).alias("_p"))
        pair = F.transform("_p", lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), F.get(F.col(states), p["i"]).alias("a"), F.get(F.col(states), p["j"]).alias("b")))
        at = rows.join(cols, group).select(group, key, F.inline(pair))
        parts = parts.unionByName(at.join(couplings, [group, "i", "j", "a", "b"]).select(group, key, "v"))
    base = rows.select(group, key, F.lit(0.0).alias("v"))
    return parts.unionByName(base).groupBy(group, key).agg((-F.sum("v")).alias("energy"))


def pair_energies(rows: DataFrame, values, fields: DataFrame, group: str = "family", key: str = "seq_id", states: str = "states", rows_a_task: int = 500_000) -> DataFrame:
    """group, key, energy over all columns and pairs of columns: ``energies`` with the couplings ``values(n, group)`` of the rows' own pair counts.

    A group's couplings are packed, one row for each first column, and meet
    the group's rows in parts of bounded size, so that what is joined are a
    few hundred rows a part, not cells. Rows must be of the group's length.
    """
    sizes, _ = _of_group(rows, group, rows_a_task)

    def pack_block(g: str, i: int, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({group: [g], "i": np.int32(i), "v": [values(n, g).astype("<f8").tobytes()]})

    blocks = pair_blocks(rows, pack_block, f"{group} string, i int, v binary", group=group, key=key, states=states)
    h = fields.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "state", "v"))).alias("h"))
    h = h.select(group, F.lit(-1).alias("i"), F.transform("h", lambda x: x["v"]).alias("h"), F.lit(None).cast("binary").alias("v"))
    params = blocks.select(group, "i", F.lit(None).cast("array<double>").alias("h"), "v").unionByName(h)
    params = params.join(sizes, group).select(group, "i", "h", "v", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"))
    mine = rows.where(F.col(states).isNotNull()).join(sizes, group).select(group, F.pmod(F.xxhash64(key), F.col("_salts")).cast("int").alias("salt"), F.col(key).alias("_k"), F.col(states).cast("array<tinyint>").alias("_s"))

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({group: np.zeros(0, object), key: np.zeros(0, np.int64), "energy": np.zeros(0)})
        x = np.stack([np.nan_to_num(np.asarray(s, np.float64)) for s in left["_s"]]).astype(np.int64)
        x = np.where((x < 0) | (x >= Q), 0, x)
        n, width = x.shape
        out = np.zeros(n)
        for i, h, v in zip(right["i"], right["h"], right["v"], strict=True):
            if i < 0:
                out -= np.asarray(h, float).reshape(width, Q)[np.arange(width)[None], x].sum(axis=1)
            else:
                block = np.frombuffer(v, "<f8").reshape(-1, Q, Q)
                out -= block[np.arange(len(block))[None], x[:, i, None], x[:, i + 1 :]].sum(axis=1)
        return pd.DataFrame({group: np.full(n, left[group].iloc[0], object), key: left["_k"].to_numpy(), "energy": out})

    return mine.groupBy(group, "salt").cogroup(params.groupBy(group, "salt")).applyInPandas(total, f"{group} string, {key} long, energy double")


def kept_couplings(values: DataFrame, pct: float, n_columns: int, group: str = "family") -> DataFrame:
    """The cells that a mask of ``pct`` percent keeps: the largest of the upper triangle by absolute value, and their mirrors.

    As many are kept as ``int(n**2 * 21**2 / 2 * (1 - pct / 100))``; ties go by the cells' order.
    """
    k = int(n_columns**2 * Q**2 / 2 * (1 - pct / 100))
    w = Window.partitionBy(group).orderBy(F.round(F.abs("v"), 9).desc(), "i", "j", "a", "b")
    up = values.where("i < j").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(group, "i", "j", "a", "b")
    return up.unionByName(up.select(group, F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("a"), F.col("a").alias("b")))


def kept_fields(values: DataFrame, pct: float, group: str = "family") -> DataFrame:
    """The cells of a dense field table that a mask of ``pct`` percent keeps."""
    w = Window.partitionBy(group)
    r = F.row_number().over(w.orderBy(F.round(F.abs("v"), 9).desc(), "pos", "state"))
    k = F.floor(F.count("*").over(w) * F.lit(1 - pct / 100))
    return values.withColumns({"_r": r, "_k": k}).where("_r <= _k").select(group, "pos", "state")


def background(single: DataFrame, totals: DataFrame, lbda: float = 0.03, group: str = "family") -> DataFrame:
    """group, state, g: the background frequencies with the group's own share of gaps."""
    gaps = single.groupBy(group).agg(F.sum(F.when(F.col("state") == 0, F.col("n")).otherwise(0)).alias("gaps"), F.sum("n").alias("all"))
    gap = (1 - lbda) * F.col("gaps") / F.col("all") + lbda / Q
    table = F.array(F.lit(None).cast("double"), *[F.lit(v) for v in BACKGROUND])
    cells = gaps.select(group, gap.alias("gap"), F.posexplode(table).alias("state", "v"))
    return cells.select(group, "state", F.when(F.col("state") == 0, F.col("gap")).otherwise((1 - F.col("gap")) * F.col("v")).alias("g"))


def position_weights(frequencies: DataFrame, ground: DataFrame, group: str = "family") -> DataFrame:
    """phi = |ln(f (1 - g) / ((1 - f) g))| and the relative entropy d of each cell; 0 where f is 0 or 1."""
    f, g = F.col("f"), F.col("g")
    inside = (f > 0) & (f < 1) & (g > 0) & (g < 1)
    x = frequencies.join(ground, [group, "state"])
    return x.select(
        group,
        "pos",
        "state",
        F.when(inside, F.abs(F.log(f * (1 - g) / ((1 - f) * g)))).otherwise(0.0).alias("phi"),
        F.when(inside, f * F.log(f / g) + (1 - f) * F.log((1 - f) / (1 - g))).otherwise(0.0).alias("d"),
    )


def weighted_correlations(correlations: DataFrame, weights: DataFrame, group: str = "family") -> DataFrame:
    """Correlations times the position weights of both cells."""
    a = weights.select(group, F.col("pos").alias("i"), F.col("state").alias("a"), F.col("phi").alias("pa"))
    b = weights.select(group, F.col("pos").alias("j"), F.col("state").alias("b"), F.col("phi").alias("pb"))
    return correlations.join(a, [group, "i", "a"]).join(b, [group, "j", "b"]).select(group, "i", "j", "a", "b", (F.col("pa") * F.col("pb") * F.col("c")).alias("v"))


def gradient(model: DataFrame, data: DataFrame, params: DataFrame, lam: float, kind: str = "L2", group: str = "family") -> DataFrame:
    """``f_model - f_data`` plus the penalty's slope, by group, pos, state. L2: 2 lam x; L1: lam (without a sign, as published)."""
    keys = [group, "pos", "state"]
    m = model.select(*keys, F.col("f").alias("m"))
    d = data.select(*keys, F.col("f").alias("d"))
    x = params.select(*keys, "v").join(m, keys, "left").join(d, keys, "left")
    slope = 2 * lam * F.col("v") if kind == "L2" else F.lit(lam)
    return x.select(*keys, (F.coalesce("m", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)) + slope).alias("g"))


