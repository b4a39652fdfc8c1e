"""Queries of sampling, fitting, components and the score reports; their results have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import frequencies as N
from seqloom.operators import potts as P
from seqloom.operators import sampling as M
from seqloom.plans import alignments as L
from seqloom.plans.problems import p1_elements


def i2_profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of each family's independent model as the family has."""
    r = L.rows(spark, sf_dir)
    return M.sample(P.profile_fields(L.dense(r)), None, L.totals(r).withColumnRenamed("total", "n"), steps=1500)


def i1_pairwise_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of each family's pairwise model at the chosen columns as the family has."""
    r = L.rows(spark, sf_dir)
    v = N.variable_columns(L.singles(r))
    h = P.profile_fields(L.dense(r).join(v, ["family", "pos"], "left_semi"))
    return M.sample(h, L.dense_couplings(r), L.totals(r).withColumnRenamed("total", "n"), steps=400)


def i4_temperature_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each family's independent model at three temperatures, with their energies at temperature 1."""
    r = L.rows(spark, sf_dir)
    h, n = P.profile_fields(L.dense(r)), L.totals(r).withColumnRenamed("total", "n")
    out = None
    for k, t in enumerate((0.5, 0.75, 1.0)):
        x = M.sample(h, None, n, steps=1000, seed=1 + k, temperature=t)
        x = P.energies(x, h, key="chain").withColumn("temperature", F.lit(t))
        out = x if out is None else out.unionByName(x)
    return out


def i5_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields' gradient: frequencies of the samples less those of the rows, with the penalty."""
    r = L.rows(spark, sf_dir)
    data = L.dense(r)
    s = N.single_counts(i2_profile_samples(spark, sf_dir))
    model = N.frequencies(s, L.totals(r)).select("family", "pos", "state", "f")
    return P.gradient(model, data, P.profile_fields(data), 0.01)


def i6_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pairwise model fitted to each family at its chosen columns: the course of the fit."""
    _, s, p, t = L.chosen(L.rows(spark, sf_dir))
    return M.fit(s, p, t)


def i11_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows' coordinates on the first two principal components of their family."""
    r = L.rows(spark, sf_dir)
    v, s, p, t = L.chosen(r)
    return M.project(N.at_columns(r, v), M.components(s, p, t))


def s12_score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sweep's groups: how many scores, their mean, median and extremes, and the median of the extra residues."""
    e = p1_elements(spark, sf_dir).where("value is not null")
    score = F.when(F.col("list_name") == "scores", F.col("value"))
    extra = F.when(F.col("list_name") == "extra_residue_counts", F.col("value"))
    return e.groupBy("sweep_id", "grp").agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.percentile(score, F.lit(0.5)).alias("median"),
        F.min(score).alias("low"),
        F.max(score).alias("high"),
        F.percentile(extra, F.lit(0.5)).alias("median_extra"),
    )


QUERIES = {f.__name__: f for f in (i1_pairwise_samples, i2_profile_samples, i4_temperature_sweep, i5_gradient, i6_fits, i11_components, s12_score_groups)}
SQL: dict[str, str] = {}
