"""Alignments as tables: wide (one row a sequence, ``states array<int>``) and long (one row a position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.records import ALPHABET

Q = len(ALPHABET)


def encode(text: Column, unknown: int = -1) -> Column:
    """Letters to states; anything outside the alphabet, lower case too, becomes ``unknown``."""
    return F.transform(F.split(text, ""), lambda c: F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(unknown)))


def decode(states: Column) -> Column:
    """States to letters; a state out of range or null becomes ``X``."""
    return F.array_join(F.transform(states, lambda s: F.when((s >= 0) & (s < Q), F.substring(F.lit(ALPHABET), s + 1, F.lit(1))).otherwise("X")), "")


def long(rows: DataFrame, *keep: str, states: str = "states") -> DataFrame:
    """``keep``, pos (from 0) and state."""
    return rows.select(*keep, F.posexplode(states).alias("pos", "state"))


def one_hot(rows: DataFrame, *keep: str, states: str = "states") -> DataFrame:
    """The set features of each row, ``feature = pos * 20 + state - 1``; gaps set none."""
    on = long(rows, *keep, states=states).where("state > 0")
    return on.select(*keep, (F.col("pos") * (Q - 1) + F.col("state") - 1).alias("feature"))


def residues(states: Column) -> Column:
    """Positions that are no gap."""
    return F.size(F.filter(states, lambda s: s > 0))


def state_sum(states: Column) -> Column:
    """The sum of the state codes, which the published length report plots."""
    return F.aggregate(states, F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(s, F.lit(0)))


def extra_residues(rows: DataFrame, reference: DataFrame, group: str = "family", states: str = "states") -> DataFrame:
    """Rows with ``extra``: residues at the columns where the group's reference row has a gap."""
    ref = reference.select(F.col(group), F.col(states).alias("_ref"))
    pairs = F.zip_with(F.col(states), F.col("_ref"), lambda s, r: ((s > 0) & (r == 0)).cast("int"))
    out = rows.join(ref, group).withColumn("extra", F.aggregate(pairs, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))))
    return out.drop("_ref")


def first_rows(rows: DataFrame, group: str = "family", key: str = "seq_id", states: str = "states") -> DataFrame:
    """The row of the least key of each group, as its reference row."""
    return rows.groupBy(group).agg(F.min_by(F.struct(F.col(key), F.col(states)), F.col(key)).alias("_m")).select(group, f"_m.{key}", f"_m.{states}")


def place_residues(rows: DataFrame, columns: DataFrame, *keep: str, group: str = "family", states: str = "states") -> DataFrame:
    """Each row's residues at the group's mapped columns, in the columns' order, gaps as ``X``; ``columns`` has group and ``cols array<int>``."""
    at = F.transform("cols", lambda c: F.when(F.coalesce(F.get(F.col(states), c), F.lit(0)) > 0, F.substring(F.lit(ALPHABET), F.get(F.col(states), c) + 1, F.lit(1))).otherwise("X"))
    return rows.join(columns.select(group, "cols"), group).select(*keep, F.array_join(at, "").alias("placed"))


# --- deterministic replacements of random choices ------------------------------------------------------------------


def draw(seed: str | Column, *keys: str) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the seed and the keys only."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


#: Rows of a group that one window ranks.
ROWS_A_WINDOW = 100_000


def ranked(rows: DataFrame, by: list[str], order: Column, key: str, rows_a_window: int | None = None) -> DataFrame:
    """Rows with ``_r``, their rank from 1 by ``order`` (whole numbers) and ``key`` within their group, and ``_n``, the group's size.

    A group is cut into ranges of ``order`` with about ``rows_a_window`` rows
    each; the windows run within a range, and the ranges before it are
    counted. Rows without a group or an order are left out.
    """
    x = rows.withColumn("_o", order)
    n = x.groupBy(*by).agg(F.count("_o").alias("_n"), F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
    ranges = F.ceil(F.col("_n") / (rows_a_window or ROWS_A_WINDOW))
    at = (F.col("_o").cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo") + 1)
    x = x.where("_o is not null").join(n, by).withColumn("_b", F.least(F.floor(at * ranges), ranges - 1)).drop("_lo", "_hi")
    counts = x.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = counts.select(*by, "_b", (F.sum("_c").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_c")).alias("_before"))
    r = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_o", key)) + F.col("_before")
    return x.join(before, [*by, "_b"]).withColumn("_r", r).drop("_o", "_b", "_before")


def in_train(rows: DataFrame, share: float = 0.8, group: str = "family", key: str = "seq_id", seed: str = "split") -> DataFrame:
    """Rows with ``is_train``: exactly ``int(share * n)`` of each group, those with the least draws."""
    x = ranked(rows, [group], draw(seed, key), key)
    return x.withColumn("is_train", F.col("_r") <= F.floor(F.col("_n") * F.lit(share))).drop("_r", "_n")


def subsample(rows: DataFrame, size: DataFrame, group: str, key: str = "seq_id", seed: str = "sample", on: list[str] | None = None) -> DataFrame:
    """``m`` rows of each group by the order of draws; ``size`` has ``m`` by the columns ``on``."""
    x = ranked(rows, [*(on or []), group], draw(seed, key), key)
    return x.join(size, on or [group]).where("_r <= m").drop("_r", "_n", "m")


def shuffle_columns(rows: DataFrame, group: str = "family", key: str = "seq_id", states: str = "states", seed: str = "shuffle") -> DataFrame:
    """Long rows whose states are permuted within each column of each group: marginals stay, correlations go."""
    x = long(rows, group, key, states=states)
    by = [group, "pos"]
    to = ranked(x, by, F.col(key), key).select(group, key, "pos", "_r")
    of = ranked(x, by, draw(seed, "pos", key), key).select(group, "pos", "state", "_r")
    return to.join(of, [*by, "_r"]).select(group, key, "pos", "state")


def batches(rows: DataFrame, size: int, group: str = "family", key: str = "seq_id", seed: str = "batch") -> DataFrame:
    """Rows with ``batch``: chunks of ``size`` in the order of draws, the last one may be short."""
    x = ranked(rows, [group], draw(seed, key), key)
    return x.withColumn("batch", F.floor((F.col("_r") - 1) / size).cast("int")).drop("_r", "_n")


def bootstrap(rows: DataFrame, n: int, group: str = "family", key: str = "seq_id", seed: str = "boot") -> DataFrame:
    """``n`` draws of rows with replacement from each group: group, rep, key."""
    index = ranked(rows.select(group, key), [group], F.col(key), key).select(group, key, (F.col("_r") - 1).alias("_i"))
    total = rows.groupBy(group).agg(F.count("*").alias("_n"))
    reps = total.select(group, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    picks = reps.withColumn("_i", draw(seed, group, "rep") % F.col("_n"))
    return picks.join(index, [group, "_i"]).select(group, "rep", key)


def random_rows(reference: DataFrame, n: int, group: str = "family", states: str = "states", seed: str = "random") -> DataFrame:
    """``n`` rows a group: the reference row with each residue replaced by a drawn one; long."""
    x = long(reference, group, states=states)
    x = x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return x.select(group, "rep", "pos", F.when(F.col("state") > 0, draw(seed, group, "rep", "pos") % (Q - 1) + 1).otherwise(0).cast("int").alias("state"))


def shuffled_rows(reference: DataFrame, n: int, group: str = "family", states: str = "states", seed: str = "shuffled") -> DataFrame:
    """``n`` rows a group: the reference row's residues permuted among its residue positions; long, gaps left out."""
    x = long(reference, group, states=states).where("state > 0")
    x = x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    by = [group, "rep"]
    to = x.select(*by, "pos", F.row_number().over(Window.partitionBy(*by).orderBy("pos")).alias("r"))
    of = x.select(*by, "state", F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, group, "rep", "pos"), "pos")).alias("r"))
    return to.join(of, [*by, "r"]).select(*by, "pos", "state")
