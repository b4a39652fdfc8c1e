"""Queries of the alignment statistics, each over all rows of its tables, with their SQL.

The alignments are the last deliveries of ``align_rows``, one alignment a
family. Pair statistics are over all columns and all cells; their queries
return a row for each pair of columns (or row, or family), as the cells of all
pairs are some hundred millions whatever the number of rows. Three-column
tables are over each family's ten most variable columns, as the published
report samples ten.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators import alignment as A
from seqloom.operators import distances as D
from seqloom.operators import frequencies as N
from seqloom.operators import potts as P
from seqloom.operators import shuffles as S
from seqloom.operators.frequencies import rounded
from seqloom.session import last_delivery, stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            # each shared table is made once; else DuckDB plans it anew at every mention
            SQL[f.__name__] = re.sub(r"\b(\w+) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", sql)
        return f

    return add


# --- shared tables ------------------------------------------------------------------------------------------------


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_delivery(table(spark, sf_dir, "align_rows"), "seq_id", keep=["family", "split", "states"]).where("states is not null").select("family", "seq_id", "split", "states")


def rows_as_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, of which less is sent: a state takes a byte on the way, and rows with a state that doesn't fit are sent whole beside it."""
    x = table(spark, sf_dir, "align_rows")
    wide = F.when((F.array_max("states") > 127) | (F.array_min("states") < -128), F.col("states"))
    x = x.withColumns({"states": F.col("states").try_cast("array<tinyint>"), "_wide": wide})
    x = last_delivery(x, "seq_id", keep=["family", "split", "states", "_wide"])
    return x.withColumn("states", F.coalesce("_wide", F.col("states").cast("array<int>"))).where("states is not null").select("family", "seq_id", "split", "states")


def totals(r: DataFrame) -> DataFrame:
    return r.groupBy("family").agg(F.count("*").alias("total"))


def widths(r: DataFrame) -> DataFrame:
    return r.groupBy("family").agg(F.max(F.size("states")).alias("n_cols"))


ROWS = """r AS (SELECT family, seq_id, split, states FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY loaded_at DESC) AS rn FROM align_rows
 WHERE seq_id IS NOT NULL) WHERE rn = 1 AND states IS NOT NULL)"""
LONG = f"""{ROWS}, x AS (SELECT family, seq_id, split, CAST(unnest(range(len(states))) AS INTEGER) AS pos, unnest(states) AS state FROM r)"""
TOTAL = "t AS (SELECT family, count(*) AS total FROM r GROUP BY family)"
SINGLE = f"{LONG}, {TOTAL}, s AS (SELECT family, pos, state, count(*) AS n FROM x GROUP BY ALL)"
COLUMNS = f"""{SINGLE}, v AS (SELECT family, pos FROM (SELECT family, pos, row_number() OVER (PARTITION BY family ORDER BY round(purity, 9), pos) AS k FROM
 (SELECT family, pos, sum(CAST(n AS DOUBLE) * n) / pow(CAST(sum(n) AS DOUBLE), 2) AS purity FROM s GROUP BY ALL)) WHERE k <= 10), y AS (SELECT x.* FROM x JOIN v USING (family, pos))"""
PAIRS = f"""{COLUMNS}, p AS (SELECT l.family, l.pos AS i, l.state AS a, k.pos AS j, k.state AS b, count(*) AS n FROM y l JOIN y k ON l.family = k.family AND l.seq_id = k.seq_id AND l.pos < k.pos GROUP BY ALL)"""
FREQ = "f AS (SELECT s.family, pos, state, n / total AS f FROM s JOIN v USING (family, pos) JOIN t USING (family))"
CORR = f"""{PAIRS}, {FREQ}, c AS (SELECT l.family, l.pos AS i, k.pos AS j, l.state AS a, k.state AS b, coalesce(p.n, 0) / t.total - l.f * k.f AS c FROM f l JOIN f k ON l.family = k.family AND l.pos < k.pos
 JOIN t ON t.family = l.family LEFT JOIN p ON p.family = l.family AND p.i = l.pos AND p.a = l.state AND p.j = k.pos AND p.b = k.state)"""
WIDTH = "w AS (SELECT family, max(len(states)) AS n_cols FROM r GROUP BY family)"
CELLS = f"""{SINGLE}, g AS (SELECT l.family, l.pos AS i, l.state AS a, k.pos AS j, k.state AS b, count(*) AS n FROM x l JOIN x k ON l.seq_id = k.seq_id AND l.pos < k.pos GROUP BY ALL)"""
DENSE = f"""{SINGLE}, {WIDTH}, cells AS (SELECT family, pos, CAST(unnest(range(21)) AS INTEGER) AS state FROM (SELECT family, CAST(unnest(range(n_cols)) AS INTEGER) AS pos FROM w)),
 d AS (SELECT family, pos, state, (1 - 1.0::DOUBLE / total) * (coalesce(n, 0)::DOUBLE / total) + 1.0::DOUBLE / total / 21 AS f FROM cells LEFT JOIN s USING (family, pos, state) JOIN t USING (family))"""
DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
ALPHA = "'-ACDEFGHIKLMNPQRSTVWY'"
TEXT = f"array_to_string(list_transform(states, lambda z: CASE WHEN z BETWEEN 0 AND 20 THEN substr({ALPHA}, z + 1, 1) ELSE 'X' END), '')"
GAPAWARE = """1 - list_sum(list_transform(range(1, len({0}.states) + 1), lambda z: CAST({0}.states[z] = {1}.states[z] AND {0}.states[z] > 0 AS INTEGER)))
 / nullif(list_sum(list_transform(range(1, len({0}.states) + 1), lambda z: CAST({0}.states[z] > 0 OR {1}.states[z] > 0 AS INTEGER))), 0)::DOUBLE"""


def singles(r: DataFrame) -> DataFrame:
    return N.single_counts(r)


def chosen(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Columns, single counts at them, pair counts and totals."""
    s = singles(r)
    v = N.variable_columns(s)
    return v, s.join(v, ["family", "pos"], "left_semi"), N.column_tuples(r, v, 2), totals(r)


def correlations(r: DataFrame) -> DataFrame:
    _, s, p, t = chosen(r)
    return N.pair_correlations(p, s, t)


def dense(r: DataFrame) -> DataFrame:
    return N.with_pseudocount(singles(r), totals(r), widths(r))


# --- sources, sinks, scalar functions -----------------------------------------------------------------------------

_FASTA = f"""SELECT record_id, family, body FROM (SELECT record_id, family, regexp_replace(regexp_replace(sequence, '^>[^\\r\\n]*', ''), '[\\r\\n \\t]', '', 'g') AS body FROM
 (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) AS rn FROM cm_fasta) WHERE rn = 1 AND fmt = 'fasta')"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = last_delivery(table(spark, sf_dir, "cm_fasta"), "record_id", keep=["family", "fmt", "sequence"]).where("fmt = 'fasta'")
    body = F.regexp_replace(F.regexp_replace("sequence", r"^>[^\r\n]*", ""), r"[\r\n \t]", "")
    return raw.select("record_id", "family", body.alias("body"))


@query(
    f"""WITH b AS ({_FASTA}) SELECT record_id, family, CAST(length(body) AS INTEGER) AS n_states, CAST(list_sum(list_transform(string_split(body, ''), lambda z: instr({ALPHA}, z) - 1)) AS BIGINT) AS state_sum, body AS text
 FROM b WHERE regexp_full_match(body, '[ACDEFGHIKLMNPQRSTVWY-]+')"""
)
def s1_fasta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA records as states; records with any other letter are left out."""
    x = _bodies(spark, sf_dir).where("body <> ''").withColumn("states", A.encode(F.col("body"))).where(~F.exists("states", lambda s: s < 0))
    return x.select("record_id", "family", F.size("states").alias("n_states"), A.state_sum(F.col("states")).alias("state_sum"), A.decode(F.col("states")).alias("text"))


@query(f"""WITH b AS ({_FASTA}) SELECT record_id, CAST(list_sum(list_transform(string_split(body, ''), lambda z: greatest(instr({ALPHA}, z) - 1, 0))) AS BIGINT) AS state_sum FROM b WHERE body <> ''""")
def s4_unknown_as_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA records as states, unknown letters read as gaps."""
    return _bodies(spark, sf_dir).where("body <> ''").select("record_id", A.state_sum(A.encode(F.col("body"), 0)).alias("state_sum"))


_ROW = r"""^("(?:[^"]|"")*"|[^",\r\n]*),("(?:[^"]|"")*"|[^",\r\n]*)(?:\r\n|\r|\n)?$"""


@query(
    f"""WITH c AS (SELECT record_id, regexp_extract(sequence, '{_ROW}', 1) AS h, regexp_extract(sequence, '{_ROW}', 2) AS q FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) AS rn FROM cm_fasta)
 WHERE rn = 1 AND fmt = 'csv' AND regexp_full_match(sequence, '{_ROW}')), d AS (SELECT record_id, CASE WHEN h LIKE '"%' THEN replace(substr(h, 2, length(h) - 2), '""', '"') ELSE h END AS h,
 regexp_replace(q, '[" \\r\\n\\t]', '', 'g') AS q FROM c) SELECT record_id, '>' || h || chr(10) || q AS fasta FROM d WHERE regexp_full_match(q, '[ACDEFGHIKLMNPQRSTVWY-]+')"""
)
def s6_csv_to_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV records with two fields as FASTA text."""
    raw = last_delivery(table(spark, sf_dir, "cm_fasta"), "record_id", keep=["fmt", "sequence"]).where("fmt = 'csv'").where(F.col("sequence").rlike(_ROW))
    h, q = F.regexp_extract("sequence", _ROW, 1), F.regexp_replace(F.regexp_extract("sequence", _ROW, 2), '[" \r\n\t]', "")
    h = F.when(h.startswith('"'), F.replace(h.substr(F.lit(2), F.length(h) - 2), F.lit('""'), F.lit('"'))).otherwise(h)
    return raw.where(q.rlike("^[ACDEFGHIKLMNPQRSTVWY-]+$")).select("record_id", F.concat(F.lit(">"), h, F.lit("\n"), q).alias("fasta"))


@query(f"WITH {ROWS} SELECT seq_id, {TEXT} AS text, sha256({TEXT}) AS hash FROM r")
def k2_text_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as text, with the SHA-256 of it."""
    return rows(spark, sf_dir).select("seq_id", A.decode(F.col("states")).alias("text")).withColumn("hash", F.sha2("text", 256))


@query(f"WITH {LONG} SELECT family, seq_id, count(*) AS n_features, CAST(sum(pos * 20 + state - 1) AS BIGINT) AS feature_sum FROM x WHERE state > 0 GROUP BY family, seq_id")
def f1_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot features of each row: how many, and their sum."""
    return A.one_hot(rows(spark, sf_dir), "family", "seq_id").groupBy("family", "seq_id").agg(F.count("*").alias("n_features"), F.sum(F.col("feature").cast("long")).alias("feature_sum"))


@query(
    f"WITH {ROWS}, m AS (SELECT family, min_by(states, seq_id) AS ref FROM r GROUP BY family) SELECT seq_id, CAST(list_sum(list_transform(range(1, len(states) + 1), lambda z: CAST(states[z] > 0 AND ref[z] = 0 AS INTEGER))) AS INTEGER) AS extra FROM r JOIN m USING (family)"
)
def f9_extra_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues at the gaps of the family's first row."""
    r = rows(spark, sf_dir)
    return A.extra_residues(r, A.first_rows(r)).select("seq_id", "extra")


@query(
    f"""WITH {COLUMNS}, k AS (SELECT family, list(pos ORDER BY pos) AS cols FROM v GROUP BY family) SELECT seq_id, array_to_string(list_transform(cols, lambda z: CASE WHEN coalesce(states[z + 1], 0) > 0
 THEN substr({ALPHA}, states[z + 1] + 1, 1) ELSE 'X' END), '') AS placed FROM r JOIN k USING (family)"""
)
def f8_placed_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's residues at its family's mapped columns."""
    r = rows(spark, sf_dir)
    cols = N.variable_columns(singles(r)).groupBy("family").agg(F.sort_array(F.collect_list("pos")).alias("cols"))
    return A.place_residues(r, cols, "seq_id")


@query(f"WITH {LONG} SELECT family, seq_id, CAST(sum(state) AS BIGINT) AS length_sum, CAST(sum(CAST(state > 0 AS INTEGER)) AS INTEGER) AS n_residues FROM x GROUP BY family, seq_id")
def f10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published length (the sum of the states) and the number of residues."""
    return rows(spark, sf_dir).select("family", "seq_id", A.state_sum(F.col("states")).alias("length_sum"), A.residues(F.col("states")).alias("n_residues"))


@query(f"WITH {DENSE} SELECT d.family, d.pos, d.state, CASE WHEN s.n IS NULL THEN -10000.0::DOUBLE ELSE round(ln(d.f) + 1e-10, 6) + 0.0 END AS v FROM d LEFT JOIN s USING (family, pos, state)")
def f12_forbidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile fields in which a state that a column never has is forbidden."""
    r = rows(spark, sf_dir)
    h = P.profile_fields(dense(r)).join(singles(r), ["family", "pos", "state"], "left")
    return h.select("family", "pos", "state", F.when(F.col("n").isNull(), -10000.0).otherwise(rounded(F.col("v"))).alias("v"))


# --- frequencies and correlations ---------------------------------------------------------------------------------


@query(f"WITH {SINGLE} SELECT family, pos, state, n FROM s")
def a3_single_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with each state at each column."""
    return singles(rows(spark, sf_dir))


@query(f"WITH {SINGLE} SELECT family, pos, state, round(n / total + 1e-10, 6) + 0.0 AS f FROM s JOIN t USING (family)")
def a2_single_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the states at each column."""
    r = rows(spark, sf_dir)
    return N.frequencies(singles(r), totals(r)).select("family", "pos", "state", rounded(F.col("f")).alias("f"))


@query(
    f"""WITH {LONG}, n AS (SELECT l.family, l.seq_id, count(*) AS c FROM r l JOIN r k ON l.family = k.family AND (l.seq_id = k.seq_id OR {GAPAWARE.format("l", "k")} < 0.3) GROUP BY ALL),
 e AS (SELECT family, sum(1.0::DOUBLE / c) AS neff FROM n GROUP BY family) SELECT x.family, pos, state, round(sum(1.0::DOUBLE / c / neff) + 1e-10, 6) + 0.0 AS f FROM x JOIN n USING (family, seq_id) JOIN e ON e.family = x.family GROUP BY ALL"""
)
def a2_weighted_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the states with rows weighted by their number of neighbours."""
    r = rows(spark, sf_dir)
    w = D.weights(r, 0.3)
    total = w.groupBy("family").agg(F.sum("w").alias("neff"))
    own = w.join(total, "family").select("seq_id", (F.col("w") / F.col("neff")).alias("p"))
    s = N.single_counts(r.join(own, "seq_id"), weight="p")
    return s.select("family", "pos", "state", rounded(F.col("n")).alias("f"))


@query(f"WITH {DENSE} SELECT family, pos, state, round(f + 1e-10, 6) + 0.0 AS f FROM d")
def f4_pseudocounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense frequencies with the pseudocount 1 / rows."""
    return dense(rows(spark, sf_dir)).select("family", "pos", "state", rounded(F.col("f")).alias("f"))


@query(
    f"""WITH {CELLS},
 u AS (SELECT family, pos, sum(pow(n::DOUBLE / total, 2)) AS u FROM s JOIN t USING (family) GROUP BY ALL),
 m AS (SELECT g.family, i, j, sum(pow(g.n::DOUBLE / total, 2) - 2 * (g.n::DOUBLE / total) * (l.n::DOUBLE / total) * (k.n::DOUBLE / total)) AS m FROM g JOIN t USING (family) JOIN s l ON l.family = g.family AND l.pos = i AND l.state = a
 JOIN s k ON k.family = g.family AND k.pos = j AND k.state = b GROUP BY ALL)
 SELECT m.family, i, j, round(sqrt(greatest(m + l.u * k.u, 0)) + 1e-10, 5) + 0.0 AS strength FROM m JOIN u l ON l.family = m.family AND l.pos = i JOIN u k ON k.family = m.family AND k.pos = j"""
)
def a4_pair_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly each two columns of a family vary together: the norm of their correlations, all columns and cells."""
    r = rows(spark, sf_dir)
    return N.block_strength(r).select("family", "i", "j", rounded(F.col("strength"), 5).alias("strength"))


@query(f"WITH {COLUMNS} SELECT family, pos FROM v")
def r2_variable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most variable columns of each family."""
    return N.variable_columns(singles(rows(spark, sf_dir)))


@query(f"WITH {CELLS} SELECT g.family, i, j, count(*) AS n_cells, round(max(n)::DOUBLE / any_value(total) + 1e-10, 6) + 0.0 AS most, round(sum(pow(n::DOUBLE / total, 2)) + 1e-10, 6) + 0.0 AS purity FROM g JOIN t USING (family) GROUP BY ALL")
def a2_pair_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of state pairs at each two columns: how many occur, the greatest, and the sum of their squares."""
    values = lambda n, _: {"n_cells": (n > 0).sum(axis=(1, 2)), "most": N.shares(n).max(axis=(1, 2)), "purity": (N.shares(n) ** 2).sum(axis=(1, 2))}
    x = N.by_pair(rows(spark, sf_dir), values, "n_cells long, most double, purity double")
    return x.withColumns({"most": rounded(F.col("most")), "purity": rounded(F.col("purity"))})


_WEIGHTS = f"""{LONG}, nb AS (SELECT l.family, l.seq_id, count(*) AS c FROM r l JOIN r k ON l.family = k.family AND (l.seq_id = k.seq_id OR {GAPAWARE.format("l", "k")} < 0.3) GROUP BY ALL),
 ne AS (SELECT family, sum(1.0::DOUBLE / c) AS neff FROM nb GROUP BY family), xw AS (SELECT x.family, x.seq_id, pos, state, 1.0::DOUBLE / c / neff AS p FROM x JOIN nb USING (family, seq_id) JOIN ne ON ne.family = x.family),
 sw AS (SELECT family, pos, state, sum(p) AS f FROM xw GROUP BY ALL), gw AS (SELECT l.family, l.pos AS i, l.state AS a, k.pos AS j, k.state AS b, sum(l.p) AS f FROM xw l JOIN xw k ON l.seq_id = k.seq_id AND l.pos < k.pos GROUP BY ALL)"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with their weights, computed once."""
    r = rows(spark, sf_dir).select("family", "seq_id", F.col("states").cast("array<tinyint>").alias("states"))
    return stored(r.join(D.weights(r, 0.3).select("seq_id", "w"), "seq_id"))


@query(f"WITH {_WEIGHTS} SELECT family, i, j, round(max(f) + 1e-10, 6) + 0.0 AS most, round(sum(f * f) + 1e-10, 6) + 0.0 AS purity FROM gw GROUP BY ALL")
def a2_weighted_pair_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with rows weighted by their number of neighbours."""
    values = lambda n, _: {"most": N.shares(n).max(axis=(1, 2)), "purity": (N.shares(n) ** 2).sum(axis=(1, 2))}
    x = N.by_pair(weighted(spark, sf_dir), values, "most double, purity double", weight="w")
    return x.withColumns({"most": rounded(F.col("most")), "purity": rounded(F.col("purity"))})


def _ends(v: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The greatest and the least value among the cells that occur."""
    return {"high": np.where(n > 0, v, -np.inf).max(axis=(1, 2)), "low": np.where(n > 0, v, np.inf).min(axis=(1, 2))}


def _rounded_ends(x: DataFrame) -> DataFrame:
    return x.withColumns({"high": rounded(F.col("high")), "low": rounded(F.col("low"))})


_ENDS = "round(max({0}) + 1e-10, 6) + 0.0 AS high, round(min({0}) + 1e-10, 6) + 0.0 AS low"


@query(f"""WITH {CELLS} SELECT g.family, i, j, {_ENDS.format("g.n::DOUBLE / total - (l.n::DOUBLE / total) * (k.n::DOUBLE / total)")} FROM g JOIN t USING (family) JOIN s l ON l.family = g.family AND l.pos = i AND l.state = a JOIN s k ON k.family = g.family AND k.pos = j AND k.state = b GROUP BY ALL""")
def a4_pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the state pairs that occur at each two columns: the greatest and the least."""
    return _rounded_ends(N.by_pair(rows(spark, sf_dir), lambda n, _: _ends(N.correlation(n), n), "high double, low double"))


@query(
    f"""WITH {_WEIGHTS}, u AS (SELECT family, pos, sum(f * f) AS u FROM sw GROUP BY ALL), m AS (SELECT gw.family, i, j, sum(gw.f * gw.f - 2 * gw.f * l.f * k.f) AS m FROM gw JOIN sw l ON l.family = gw.family AND l.pos = i AND l.state = a
 JOIN sw k ON k.family = gw.family AND k.pos = j AND k.state = b GROUP BY ALL) SELECT m.family, i, j, round(sqrt(greatest(m + l.u * k.u, 0)) + 1e-10, 5) + 0.0 AS strength FROM m JOIN u l ON l.family = m.family AND l.pos = i JOIN u k ON k.family = m.family AND k.pos = j"""
)
def a4_weighted_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly each two columns vary together, rows weighted by their number of neighbours."""
    return N.block_strength(weighted(spark, sf_dir), weight="w").select("family", "i", "j", rounded(F.col("strength"), 5).alias("strength"))


@query(
    f"""WITH {PAIRS}, {FREQ}, q AS (SELECT l.family, l.pos AS i, l.state AS a, k.pos AS j, k.state AS b, m.pos AS k, m.state AS c, count(*) AS n FROM y l JOIN y k ON l.seq_id = k.seq_id AND l.pos < k.pos
 JOIN y m ON m.seq_id = k.seq_id AND k.pos < m.pos GROUP BY ALL), g AS (SELECT p.family, i, a, j, b, n / total AS f FROM p JOIN t USING (family))
 SELECT q.family, q.i, q.j, q.k, q.a, q.b, q.c, round(q.n / t.total - ij.f * fk.f - ik.f * fj.f - jk.f * fi.f + 2 * fi.f * fj.f * fk.f + 1e-10, 6) + 0.0 AS c3 FROM q JOIN t USING (family)
 JOIN f fi ON fi.family = q.family AND fi.pos = q.i AND fi.state = q.a JOIN f fj ON fj.family = q.family AND fj.pos = q.j AND fj.state = q.b JOIN f fk ON fk.family = q.family AND fk.pos = q.k AND fk.state = q.c
 JOIN g ij ON ij.family = q.family AND ij.i = q.i AND ij.a = q.a AND ij.j = q.j AND ij.b = q.b JOIN g ik ON ik.family = q.family AND ik.i = q.i AND ik.a = q.a AND ik.j = q.k AND ik.b = q.c
 JOIN g jk ON jk.family = q.family AND jk.i = q.j AND jk.a = q.b AND jk.j = q.k AND jk.b = q.c"""
)
def a5_triple_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the state triples that occur at the chosen columns."""
    r = rows(spark, sf_dir)
    v, s, p, t = chosen(r)
    c = N.triple_correlations(N.column_tuples(r, v, 3), p, s, t)
    return c.withColumn("c3", rounded(F.col("c3")))


@query(
    f"""WITH {LONG}, g AS (SELECT family, pos, state, split, count(*) AS n FROM x WHERE split IN ('Train', 'Test') GROUP BY ALL), h AS (SELECT family, split, count(*) AS total FROM r WHERE split IN ('Train', 'Test') GROUP BY ALL),
 z AS (SELECT family, pos, state, sum(CASE WHEN split = 'Train' THEN n::DOUBLE / total ELSE 0 END) AS a, sum(CASE WHEN split = 'Test' THEN n::DOUBLE / total ELSE 0 END) AS b FROM g JOIN h USING (family, split) GROUP BY ALL)
 SELECT family, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN round(corr(a, b) + 1e-10, 6) + 0.0 END AS pearson FROM z GROUP BY family"""
)
def a15_train_test_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the frequencies of the Test rows follow those of the Train rows."""
    r = rows(spark, sf_dir).where("split in ('Train', 'Test')")
    n = r.groupBy("family", "split").agg(F.count("*").alias("total"))
    g = A.long(r, "family", "split").groupBy("family", "split", "pos", "state").agg(F.count("*").alias("n")).join(n, ["family", "split"])
    f = F.col("n") / F.col("total")
    side = lambda s: F.sum(F.when(F.col("split") == s, f).otherwise(0.0))
    z = g.groupBy("family", "pos", "state").agg(side("Train").alias("a"), side("Test").alias("b"))
    return z.groupBy("family").agg(rounded(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))).alias("pearson"))


# --- distances ----------------------------------------------------------------------------------------------------


@query(f"WITH {ROWS} SELECT l.family, l.seq_id, count(*) AS neighbours, round(1.0::DOUBLE / count(*) + 1e-10, 6) + 0.0 AS w FROM r l JOIN r k ON l.family = k.family AND (l.seq_id = k.seq_id OR {GAPAWARE.format('l', 'k')} < 0.3) GROUP BY ALL")
def a1_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each row: one by the rows nearer than 0.3, gaps left out."""
    return D.weights(rows(spark, sf_dir), 0.3).withColumn("w", rounded(F.col("w")))


@query(
    f"""WITH {ROWS} SELECT l.family, l.seq_id, count(*) AS neighbours, round(1.0::DOUBLE / count(*) + 1e-10, 6) + 0.0 AS w FROM r l JOIN r k ON l.family = k.family AND (l.seq_id = k.seq_id OR
 round(1 - list_sum(list_transform(range(1, len(l.states) + 1), lambda z: CAST(l.states[z] = k.states[z] AS INTEGER))) / len(l.states)::DOUBLE, 9) < 0.3) GROUP BY ALL"""
)
def a1_hamming_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by plain Hamming distance, gaps as a state."""
    return D.weights(rows(spark, sf_dir), 0.3 - 5e-10, kind=D.HAMMING).withColumn("w", rounded(F.col("w")))


_NEAREST = f"""{ROWS}, n AS (SELECT l.family, l.seq_id, min({GAPAWARE.format("l", "k")}) AS d FROM r l JOIN r k ON l.family = k.family AND k.split = 'Train' WHERE l.split = 'Test' GROUP BY ALL)"""


def _test_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return D.nearest(r.where("split = 'Test'"), r.where("split = 'Train'"))


@query(f"WITH {_NEAREST} SELECT family, seq_id, round(d + 1e-10, 6) + 0.0 AS d FROM n WHERE d IS NOT NULL")
def j4_nearest_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each Test row to the nearest Train row of its family."""
    return _test_nearest(spark, sf_dir).withColumn("d", rounded(F.col("d")))


@query(f"WITH {_NEAREST} SELECT family, count(*) AS n, round(min(1 - d) + 1e-10, 6) + 0.0 AS low, round(quantile_cont(1 - d, 0.5) + 1e-10, 6) + 0.0 AS median, round(max(1 - d) + 1e-10, 6) + 0.0 AS high FROM n WHERE d IS NOT NULL GROUP BY family")
def a17_similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the Test rows to the nearest Train row: least, median and greatest."""
    s = _test_nearest(spark, sf_dir).withColumn("s", 1 - F.col("d"))
    return s.groupBy("family").agg(
        F.count("*").alias("n"), rounded(F.min("s")).alias("low"), rounded(F.percentile("s", F.lit(0.5))).alias("median"), rounded(F.max("s")).alias("high")
    )


@query(f"WITH {ROWS}, n AS (SELECT l.family, l.seq_id, min({GAPAWARE.format('l', 'k')}) AS d FROM r l JOIN r k ON l.family = k.family AND l.seq_id <> k.seq_id GROUP BY ALL) SELECT family, seq_id, round(d + 1e-10, 6) + 0.0 AS d FROM n WHERE d IS NOT NULL")
def j3_nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each row to the nearest other row of its family."""
    return D.nearest(rows_as_bytes(spark, sf_dir)).withColumn("d", rounded(F.col("d")))


@query(
    f"""WITH {ROWS}, n AS (SELECT l.family, {GAPAWARE.format("l", "k")} AS d FROM r l JOIN r k ON l.family = k.family AND l.seq_id < k.seq_id)
 SELECT family, CAST(least(floor(round(d * 20, 9)), 19) AS INTEGER) AS bin, count(*) AS n FROM n WHERE d IS NOT NULL GROUP BY ALL"""
)
def j1_diversity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of each family by their distance."""
    return D.distance_histogram(rows_as_bytes(spark, sf_dir))


# --- masks and parameters -----------------------------------------------------------------------------------------

_TOP = """(SELECT family, i, j, a, b FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(abs({1}), 9) DESC, i, j, a, b) AS k FROM {0}) WHERE k <= {2})"""


@query()
def t1_coupling_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a 98 percent mask by correlation keeps in the upper triangle, over all columns: by pair of columns their number and the sum of their codes."""
    return N.kept_by_pair(rows(spark, sf_dir), N.correlation, 98)


@query()
def t5_conserved_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by correlations weighted by conservation, gaps left out."""
    r = rows(spark, sf_dir)
    return N.kept_by_pair(r, _conserved(r, 1), 98)


@query("WITH w AS (SELECT family, max(len(states)) AS l FROM align_rows WHERE states IS NOT NULL GROUP BY family) SELECT family, round(1 - 2 * floor(l * l * 441 / 2 * (1 - 98 / 100.0::DOUBLE) + 1e-9) / (l * l * 441.0::DOUBLE) + 1e-10, 6) + 0.0 AS sparsity FROM w")
def a19_mask_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cells that the mask leaves out, the diagonal included."""
    r = rows(spark, sf_dir)
    k = N.kept_by_pair(r, N.correlation, 98).groupBy("family").agg(F.sum("n_kept").alias("n")).join(widths(r), "family")
    return k.select("family", rounded(1 - 2 * F.col("n") / (F.col("n_cols") * F.col("n_cols") * 441.0)).alias("sparsity"))


_FIELD_TOP = "(SELECT family, pos, state FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(abs({1}), 9) DESC, pos, state) AS k, count(*) OVER (PARTITION BY family) AS n FROM {0}) WHERE k <= floor(n * (1 - 90 / 100.0::DOUBLE)))"


@query(f"WITH {DENSE} SELECT * FROM {_FIELD_TOP.format('d', 'f')}")
def t2_field_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a 90 percent mask by frequency keeps."""
    return P.kept_fields(dense(rows(spark, sf_dir)).withColumnRenamed("f", "v"), 90)


_GROUND = f"""{DENSE}, b AS (SELECT family, (1 - 0.03) * sum(CASE WHEN state = 0 THEN n ELSE 0 END)::DOUBLE / sum(n) + 0.03 / 21 AS gap FROM s GROUP BY family),
 g AS (SELECT family, state, CASE WHEN state = 0 THEN gap ELSE (1 - gap) * q END AS g FROM b, (SELECT CAST(unnest(range(21)) AS INTEGER) AS state, unnest([NULL::DOUBLE, {", ".join(f"{v}::DOUBLE" for v in P.BACKGROUND)}]) AS q))"""
_PHI = f"""{_GROUND}, o AS (SELECT d.family, pos, state, abs(ln(f * (1 - g) / ((1 - f) * g))) AS phi, f * ln(f / g) + (1 - f) * ln((1 - f) / (1 - g)) AS e FROM d JOIN g USING (family, state))"""


@query(f"WITH {_GROUND} SELECT family, state, round(g + 1e-10, 6) + 0.0 AS g FROM g")
def a8_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background frequencies with each family's own share of gaps."""
    r = rows(spark, sf_dir)
    return P.background(singles(r), totals(r)).withColumn("g", rounded(F.col("g")))


def _position_weights(r: DataFrame) -> DataFrame:
    return P.position_weights(dense(r), P.background(singles(r), totals(r)))


@query(f"WITH {_PHI} SELECT family, pos, state, round(phi + 1e-10, 6) + 0.0 AS phi, round(e + 1e-10, 6) + 0.0 AS d FROM o")
def a7_position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conservation of each cell against the background: its weight and its relative entropy."""
    return _position_weights(rows(spark, sf_dir)).withColumns({"phi": rounded(F.col("phi")), "d": rounded(F.col("d"))})


@query(f"WITH {_PHI} SELECT * FROM {_FIELD_TOP.format('o', 'e')}")
def t2_entropy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a 90 percent mask by relative entropy keeps."""
    return P.kept_fields(_position_weights(rows(spark, sf_dir)).select("family", "pos", "state", F.col("d").alias("v")), 90)


def _conserved(r: DataFrame, first: int):
    """Correlations times the position weights of both cells, from state ``first`` on; a group's background is known by its share of gaps."""
    gaps = P.background(singles(r), totals(r)).where("state = 0").select("family", "g").limit(N.MOST_BROADCAST)
    gap = {x["family"]: x["g"] for x in gaps.collect()}

    def values(n: np.ndarray, family: str) -> np.ndarray:
        g = np.concatenate([[gap[family]], (1 - gap[family]) * np.array(P.BACKGROUND)])
        p = N.with_pair_pseudocount(n)
        phi = lambda f: np.abs(np.log(f * (1 - g) / ((1 - f) * g)))
        v = phi(p.sum(axis=2))[:, :, None] * phi(p.sum(axis=1))[:, None, :] * N.correlation(n)
        v[:, :first] = 0
        v[:, :, :first] = 0
        return v

    return values


_PHI_CELLS = f"""{_PHI.replace("g AS (", "bg AS (").replace("JOIN g USING", "JOIN bg USING")}, {CELLS.removeprefix(SINGLE + ", ")}"""


@query(f"""WITH {_PHI_CELLS} SELECT g.family, i, j, {_ENDS.format("lo.phi * ko.phi * (g.n::DOUBLE / total - (l.n::DOUBLE / total) * (k.n::DOUBLE / total))")} FROM g JOIN t USING (family) JOIN s l ON l.family = g.family AND l.pos = i AND l.state = a
 JOIN s k ON k.family = g.family AND k.pos = j AND k.state = b JOIN o lo ON lo.family = g.family AND lo.pos = i AND lo.state = a JOIN o ko ON ko.family = g.family AND ko.pos = j AND ko.state = b GROUP BY ALL""".replace("{CELLS}", CELLS))
def a7_weighted_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations weighted by the conservation of both cells, of the pairs that occur: the greatest and the least."""
    r = rows(spark, sf_dir)
    values = _conserved(r, 0)
    return _rounded_ends(N.by_pair(r, lambda n, g: _ends(values(n, g), n), "high double, low double"))


@query(f"WITH {DENSE} SELECT family, pos, state, round(ln(f) + 1e-10, 6) + 0.0 AS v FROM d")
def i9_profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the independent model."""
    return P.profile_fields(dense(rows(spark, sf_dir))).withColumn("v", rounded(F.col("v")))


# couplings are log odds with pseudocounts: e is what a cell that occurs has beyond one that does not (z0), ld the logarithm of the single frequency
_ODDS = f"""{DENSE}, {CELLS.removeprefix(SINGLE + ", ")}, e AS (SELECT g.*, ln(((1 - 1.0::DOUBLE / total) * n / total + 1.0::DOUBLE / total / 441) / (1.0::DOUBLE / total / 441)) AS e FROM g JOIN t USING (family)),
 z AS (SELECT family, ln(1.0::DOUBLE / total / 441) AS z0 FROM t), q AS (SELECT family, pos, sum(ln(f)) AS s1, sum(ln(f) * ln(f)) AS s2 FROM d GROUP BY ALL)"""


@query(
    f"""WITH {_ODDS}, c AS (SELECT e.family, i, j, sum(e) AS e FROM e GROUP BY ALL) SELECT c.family, i, j, CAST(i * (2 * n_cols - i - 1) / 2 + j - i - 1 AS BIGINT) * 441 AS "offset", round(e + 441 * z0 - 21 * (l.s1 + k.s1) + 1e-10, 4) + 0.0 AS total FROM c JOIN w USING (family) JOIN z ON z.family = c.family
 JOIN q l ON l.family = c.family AND l.pos = i JOIN q k ON k.family = c.family AND k.pos = j UNION ALL SELECT q.family, pos AS i, -1 AS j, CAST(n_cols * (n_cols - 1) / 2 AS BIGINT) * 441 + pos * 21 AS "offset", round(s1 + 1e-10, 4) + 0.0 AS total FROM q JOIN w USING (family)"""
)
def f2_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and couplings of each family as one packed vector: where each block begins, and its sum."""
    r = rows(spark, sf_dir)
    w = widths(r).withColumnRenamed("n_cols", "width")
    j = N.by_pair(r, lambda n, _: {"total": N.log_odds(n).sum(axis=(1, 2))}, "total double").join(w, "family")
    zero = {"a": F.lit(0), "b": F.lit(0)}
    j = j.withColumns(zero).withColumn("offset", P.coupling_offset()).select("family", "i", "j", "offset", rounded(F.col("total"), 4).alias("total"))
    h = P.profile_fields(dense(r)).groupBy("family", "pos").agg(F.sum("v").alias("total")).join(w, "family").withColumn("state", F.lit(0))
    return j.unionByName(h.select("family", F.col("pos").alias("i"), F.lit(-1).alias("j"), P.field_offset().alias("offset"), rounded(F.col("total"), 4).alias("total")))


@query(f"""WITH {DENSE} SELECT family, pos, state, round(ln(f) / 0.75 + 1e-10, 6) + 0.0 AS v FROM d""")
def f3_unpacked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields taken out of the packed vector, at temperature 0.75."""
    r = rows(spark, sf_dir)
    w = widths(r).withColumnRenamed("n_cols", "width")
    kept = N.kept_cells(r, N.correlation, 98).select("family", "i", "j", "a", "b", "v")
    h, _ = P.unpack(P.pack(P.profile_fields(dense(r)), kept, w), w)
    return h.withColumn("v", rounded(F.col("v") / 0.75))


def dense_couplings(r: DataFrame) -> DataFrame:
    v, s, p, t = chosen(r)
    cols = v.select("family", F.col("pos").alias("i")).join(v.select("family", F.col("pos").alias("j")), "family").where("i < j")
    state = lambda c: F.explode(F.sequence(F.lit(0), F.lit(A.Q - 1))).alias(c)
    cells = cols.select("family", "i", "j", state("a")).select("family", "i", "j", "a", state("b"))
    c = N.pair_correlations(p, s, t)
    return cells.join(c, ["family", "i", "j", "a", "b"], "left").select("family", "i", "j", "a", "b", F.coalesce("c", F.lit(0.0)).alias("v"))


@query(
    f"""WITH {_ODDS}, ra AS (SELECT family, i, j, a, sum(e) / 21 AS ra FROM e GROUP BY ALL), cb AS (SELECT family, i, j, b, sum(e) / 21 AS cb FROM e GROUP BY ALL), bm AS (SELECT family, i, j, sum(e) / 441 AS bm FROM e GROUP BY ALL)
 SELECT e.family, e.i, e.j, {_ENDS.format("e - ra - cb + bm")} FROM e JOIN ra ON ra.family = e.family AND ra.i = e.i AND ra.j = e.j AND ra.a = e.a JOIN cb ON cb.family = e.family AND cb.i = e.i AND cb.j = e.j AND cb.b = e.b JOIN bm ON bm.family = e.family AND bm.i = e.i AND bm.j = e.j GROUP BY ALL"""
)
def w1_gauge_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couplings in the zero-sum gauge, of the pairs that occur: the greatest and the least."""
    return _rounded_ends(N.by_pair(rows(spark, sf_dir), lambda n, _: _ends(N.centred(N.log_odds(n)), n), "high double, low double"))


@query(
    f"""WITH {_ODDS}, ra AS (SELECT family, i AS pos, a AS state, sum(e) / 21 AS m FROM e GROUP BY ALL UNION ALL SELECT family, j AS pos, b AS state, sum(e) / 21 AS m FROM e GROUP BY ALL), ma AS (SELECT family, pos, state, sum(m) AS m FROM ra GROUP BY ALL),
 bm AS (SELECT family, pos, sum(m) / 21 AS m FROM ma GROUP BY ALL) SELECT d.family, d.pos, d.state, round((ln(f) - s1 / 21) * (2 - n_cols) + coalesce(ma.m, 0) - coalesce(bm.m, 0) + 1e-10, 5) + 0.0 AS v
 FROM d JOIN q ON q.family = d.family AND q.pos = d.pos JOIN w ON w.family = d.family LEFT JOIN ma ON ma.family = d.family AND ma.pos = d.pos AND ma.state = d.state LEFT JOIN bm ON bm.family = d.family AND bm.pos = d.pos"""
)
def w2_gauge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in the zero-sum gauge, with what the couplings of all pairs of columns give them."""
    r = rows(spark, sf_dir)
    moved = N.gauge_shifts(r, N.log_odds)
    h = P.profile_fields(dense(r))
    h = h.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("family", "pos")))
    return h.join(moved, ["family", "pos", "state"], "left").select("family", "pos", "state", rounded(F.col("v") + F.coalesce("x", F.lit(0.0)), 5).alias("v"))


@query(
    f"""WITH {_ODDS}, c2 AS (SELECT family, i, j, sum(e * e) AS e2, sum(e) AS e1 FROM e GROUP BY ALL), ra AS (SELECT family, i, j, sum(m * m) / 21 AS ra FROM (SELECT family, i, j, a, sum(e) AS m FROM e GROUP BY ALL) GROUP BY ALL), cb AS (SELECT family, i, j, sum(m * m) / 21 AS cb FROM (SELECT family, i, j, b, sum(e) AS m FROM e GROUP BY ALL) GROUP BY ALL)
 SELECT family, i, j, round(sqrt(greatest(e2 - ra - cb + e1 * e1 / 441, 0)) + 1e-10, 5) + 0.0 AS norm FROM c2 JOIN ra USING (family, i, j) JOIN cb USING (family, i, j)"""
)
def a10_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of each block of gauged couplings."""
    norm = lambda v: np.sqrt((v * v).sum(axis=(1, 2)))
    x = N.by_pair(rows(spark, sf_dir), lambda n, _: {"norm": norm(N.centred(N.log_odds(n)))}, "norm double")
    return x.withColumn("norm", rounded(F.col("norm"), 5))


@query(
    f"""WITH {_ODDS}, c AS (SELECT e.family, e.i, e.j, sum(e * e + 2 * e * (z0 - ln(l.f) - ln(k.f))) AS m FROM e JOIN z ON z.family = e.family JOIN d l ON l.family = e.family AND l.pos = e.i AND l.state = e.a JOIN d k ON k.family = e.family AND k.pos = e.j AND k.state = e.b GROUP BY ALL),
 n AS (SELECT c.family, sqrt(greatest(m + 441 * z0 * z0 + 21 * (l.s2 + k.s2) - 42 * z0 * (l.s1 + k.s1) + 2 * l.s1 * k.s1, 0)) AS norm FROM c JOIN z ON z.family = c.family JOIN q l ON l.family = c.family AND l.pos = i JOIN q k ON k.family = c.family AND k.pos = j)
 SELECT n.family, round(2 * sum(norm) / any_value(n_cols * n_cols)::DOUBLE, 3) AS j_norm FROM n JOIN w USING (family) GROUP BY n.family"""
)
def a10_mean_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean norm of the coupling blocks over all ordered pairs of columns, as recorded in training."""
    r = rows(spark, sf_dir)
    x = N.by_pair(r, lambda n, _: {"norm": np.sqrt((N.log_odds(n) ** 2).sum(axis=(1, 2)))}, "norm double").groupBy("family").agg(F.sum("norm").alias("s"))
    return x.join(widths(r), "family").select("family", F.round(2 * F.col("s") / (F.col("n_cols") * F.col("n_cols")), 3).alias("j_norm"))


_ENERGY = f"""{_ODDS}, pe AS (SELECT l.family, l.seq_id, sum(e + z0) AS v FROM x l JOIN x k ON l.seq_id = k.seq_id AND l.pos < k.pos JOIN e ON e.family = l.family AND e.i = l.pos AND e.j = k.pos AND e.a = l.state AND e.b = k.state JOIN z ON z.family = l.family GROUP BY ALL),
 fe AS (SELECT x.family, seq_id, sum(ln(f)) AS v, any_value(n_cols) AS l FROM x JOIN d USING (family, pos, state) JOIN w ON w.family = x.family GROUP BY ALL), en AS (SELECT fe.family, fe.seq_id, -(coalesce(pe.v, 0) - (l - 1) * fe.v + fe.v) AS energy FROM fe LEFT JOIN pe USING (family, seq_id))"""


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return P.pair_energies(r, N.log_odds, P.profile_fields(dense(r)))


@query(f"WITH {_ENERGY} SELECT family, seq_id, round(energy + 1e-10, 5) + 0.0 AS energy FROM en")
def a9_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical energy of each row: fields of all columns, couplings of all pairs of columns."""
    return _energies(spark, sf_dir).withColumn("energy", rounded(F.col("energy"), 5))


def histogram(values: DataFrame, value: str, bins: int, group: str = "family") -> DataFrame:
    """group, bin, n and density over ``bins`` steps of the group's own range, the last closed; a range of 0 is widened by 0.5 on either side."""
    ends = values.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    flat = F.col("hi") == F.col("lo")
    ends = ends.select(group, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total")
    x = values.where(F.col(value).isNotNull()).join(ends, group)
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.round((F.col(value) - F.col("lo")) / step, 9)), F.lit(bins - 1)).cast("int")
    out = x.groupBy(group, at.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    return out.select(group, "bin", "n", rounded(F.col("n") / (F.col("total") * step)).alias("density"))


_HIST = """h AS (SELECT family, CASE WHEN min(z) = max(z) THEN min(z) - 0.5 ELSE min(z) END AS lo, CASE WHEN min(z) = max(z) THEN max(z) + 0.5 ELSE max(z) END AS hi, count(*) AS total FROM q GROUP BY family)
 SELECT family, CAST(least(floor(round((z - lo) / ((hi - lo) / {0}), 9)), {0} - 1) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (any_value(total) * ((any_value(hi) - any_value(lo)) / {0})) + 1e-10, 6) + 0.0 AS density FROM q JOIN h USING (family) GROUP BY 1, 2"""


@query(f"WITH {LONG}, q AS (SELECT family, sum(state)::DOUBLE AS z FROM x GROUP BY family, seq_id), {_HIST.format(80)}")
def a16_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each family by the published length."""
    return histogram(rows(spark, sf_dir).select("family", A.state_sum(F.col("states")).cast("double").alias("z")), "z", 80)


@query(f"WITH {_ENERGY}, qq AS (SELECT family, round(energy, 5) AS z FROM en), {_HIST.format(60).replace("FROM q", "FROM qq")}")
def a16_energy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each family by energy."""
    return histogram(_energies(spark, sf_dir).select("family", F.round("energy", 5).alias("z")), "z", 60)


@query(
    f"""WITH {LONG}, q AS (SELECT family, sum(CAST(state > 0 AS INTEGER))::DOUBLE AS u, sum(state)::DOUBLE AS z FROM x GROUP BY family, seq_id)
 SELECT family, round(regr_slope(z, u) + 1e-10, 6) + 0.0 AS slope, round(regr_intercept(z, u) + 1e-10, 6) + 0.0 AS intercept, round(regr_r2(z, u) + 1e-10, 6) + 0.0 AS r2 FROM q GROUP BY family"""
)
def a20_fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares line of the published length by the number of residues."""
    q = rows(spark, sf_dir).select("family", A.residues(F.col("states")).cast("double").alias("u"), A.state_sum(F.col("states")).cast("double").alias("z"))
    return q.groupBy("family").agg(
        rounded(F.regr_slope("z", "u")).alias("slope"), rounded(F.regr_intercept("z", "u")).alias("intercept"), rounded(F.regr_r2("z", "u")).alias("r2")
    )


# --- choices by hash ----------------------------------------------------------------------------------------------


@query(f"WITH {ROWS} SELECT family, seq_id, row_number() OVER (PARTITION BY family ORDER BY {DRAW.format(chr(39) + 'split:' + chr(39) + ' || seq_id')}, seq_id) <= floor(count(*) OVER (PARTITION BY family) * 0.8::DOUBLE) AS is_train FROM r")
def r1_train_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of each family's rows as Train, by draws."""
    return A.in_train(rows(spark, sf_dir)).select("family", "seq_id", "is_train")


@query(
    f"""WITH {ROWS}, c AS (SELECT family, split, count(*) AS n FROM r WHERE split IS NOT NULL GROUP BY ALL), m AS (SELECT family, min(n) AS m FROM c GROUP BY family)
 SELECT family, split, seq_id FROM (SELECT r.*, m, row_number() OVER (PARTITION BY family, split ORDER BY {DRAW.format(chr(39) + 'sample:' + chr(39) + ' || seq_id')}, seq_id) AS k FROM r JOIN m USING (family) WHERE split IS NOT NULL) WHERE k <= m"""
)
def r2_equal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of each split as the smallest has, by draws."""
    r = rows(spark, sf_dir).where("split is not null")
    m = r.groupBy("family", "split").agg(F.count("*").alias("n")).groupBy("family").agg(F.min("n").alias("m"))
    return A.subsample(r, m, "split", on=["family"]).select("family", "split", "seq_id")


@query(
    f"""WITH {LONG}, o AS (SELECT family, pos, seq_id, row_number() OVER (PARTITION BY family, pos ORDER BY seq_id) AS k FROM x), q AS (SELECT family, pos, state, row_number() OVER (PARTITION BY family, pos ORDER BY {DRAW.format(chr(39) + 'shuffle:' + chr(39) + " || pos || ':' || seq_id")}, seq_id) AS k FROM x)
 SELECT family, seq_id, CAST(sum((pos + 1) * state) AS BIGINT) AS checksum FROM o JOIN q USING (family, pos, k) GROUP BY ALL"""
)
def r3_shuffled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns permuted on their own: a checksum of each resulting row."""
    return S.shuffled_checksums(rows_as_bytes(spark, sf_dir))


_REF = f"{ROWS}, m AS (SELECT family, min_by(states, seq_id) AS ref FROM r GROUP BY family), z AS (SELECT family, CAST(unnest(range(len(ref))) AS INTEGER) AS pos, unnest(ref) AS state FROM m), n AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS rep)"


@query(f"WITH {_REF} SELECT family, rep, pos, CAST(CASE WHEN state > 0 THEN {DRAW.format(chr(39) + 'random:' + chr(39) + chr(32) + '|| family || ' + chr(39) + ':' + chr(39) + ' || rep || ' + chr(39) + ':' + chr(39) + ' || pos')} % 20 + 1 ELSE 0 END AS INTEGER) AS state FROM z, n")
def r4_random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows a family with drawn residues where the first row has any."""
    return A.random_rows(A.first_rows(rows(spark, sf_dir)), 20)


@query(
    f"""WITH {_REF}, q AS (SELECT * FROM z, n WHERE state > 0), o AS (SELECT family, rep, pos, row_number() OVER (PARTITION BY family, rep ORDER BY pos) AS k FROM q),
 u AS (SELECT family, rep, state, row_number() OVER (PARTITION BY family, rep ORDER BY {DRAW.format("'shuffled:' || family || ':' || rep || ':' || pos")}, pos) AS k FROM q) SELECT family, rep, pos, state FROM o JOIN u USING (family, rep, k)"""
)
def r5_shuffled_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows a family with the first row's residues permuted."""
    return A.shuffled_rows(A.first_rows(rows(spark, sf_dir)), 20)


@query(
    f"""WITH {ROWS}, {TOTAL}, i AS (SELECT family, seq_id, row_number() OVER (PARTITION BY family ORDER BY seq_id) - 1 AS k FROM r), q AS (SELECT family, total, CAST(unnest(range(50)) AS INTEGER) AS rep FROM t)
 SELECT q.family, rep, seq_id FROM q JOIN i ON i.family = q.family AND i.k = {DRAW.format("'boot:' || q.family || ':' || rep")} % total"""
)
def r6_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows of each family drawn with replacement."""
    return A.bootstrap(rows(spark, sf_dir), 50)


@query(f"WITH {ROWS} SELECT family, seq_id, CAST(floor((row_number() OVER (PARTITION BY family ORDER BY {DRAW.format(chr(39) + 'batch:' + chr(39) + ' || seq_id')}, seq_id) - 1) / 32) AS INTEGER) AS batch FROM r")
def r9_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 rows in the order of draws."""
    return A.batches(rows(spark, sf_dir), 32).select("family", "seq_id", "batch")


_RUNS = f"""{LONG}, y AS (SELECT * FROM x), k AS (SELECT family, seq_id, {DRAW.format("'run:' || seq_id")} % 5 AS run FROM r), c AS (SELECT family, run, count(*) AS c FROM k GROUP BY ALL), g AS (SELECT y.family, run, pos, state, count(*) AS n FROM y JOIN k USING (family, seq_id) GROUP BY ALL),
 e AS (SELECT c.family, c.run, q.pos, q.state, coalesce(g.n, 0)::DOUBLE / c.c AS v FROM c JOIN (SELECT DISTINCT family, pos, state FROM y) q USING (family) LEFT JOIN g ON g.family = c.family AND g.run = c.run AND g.pos = q.pos AND g.state = q.state)"""


def _runs(r: DataFrame) -> DataFrame:
    """Frequencies of five parts of each family's rows, as repeated runs give parameters."""
    y = A.long(r, "family", "seq_id")
    part = (A.draw("run", "seq_id") % 5).alias("run")
    n = r.select("family", part).groupBy("family", "run").agg(F.count("*").alias("c"))
    g = y.select("family", part, "pos", "state").groupBy("family", "run", "pos", "state").agg(F.count("*").alias("n"))
    cells = n.join(y.select("family", "pos", "state").distinct(), "family")
    return cells.join(g, ["family", "run", "pos", "state"], "left").select("family", "run", "pos", "state", (F.coalesce("n", F.lit(0)) / F.col("c")).alias("v"))


@query(f"WITH {_RUNS} SELECT family, pos, state, round(avg(v) + 1e-10, 6) + 0.0 AS v FROM e GROUP BY ALL")
def a12_replicate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the runs' parameters."""
    return _runs(rows(spark, sf_dir)).groupBy("family", "pos", "state").agg(rounded(F.avg("v")).alias("v"))


@query(
    f"""WITH {_RUNS}, m AS (SELECT *, avg(v) OVER u AS mv, stddev_pop(v) OVER u AS sd FROM e WINDOW u AS (PARTITION BY family, pos, state)), o AS (SELECT family, run, sum(CAST(v - mv > sd + 1e-12 AS INTEGER)) AS o FROM m GROUP BY ALL),
 z AS (SELECT family, run FROM (SELECT *, avg(o) OVER (PARTITION BY family) AS mo, stddev_pop(o) OVER (PARTITION BY family) AS so FROM o) WHERE o - mo <= so + 1e-12) SELECT family, pos, state, round(avg(v) + 1e-10, 6) + 0.0 AS v FROM e JOIN z USING (family, run) GROUP BY ALL"""
)
def a13_mean_without_outlying_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the runs but those with unusually many high parameters."""
    e = _runs(rows(spark, sf_dir))
    u, f = Window.partitionBy("family", "pos", "state"), Window.partitionBy("family")
    m = e.withColumn("high", (F.col("v") - F.avg("v").over(u) > F.stddev_pop("v").over(u) + 1e-12).cast("int"))
    o = m.groupBy("family", "run").agg(F.sum("high").alias("o"))
    out = o.withColumn("out", F.col("o") - F.avg("o").over(f) > F.stddev_pop("o").over(f) + 1e-12).where("out").select("family", "run")
    return e.join(out, ["family", "run"], "left_anti").groupBy("family", "pos", "state").agg(rounded(F.avg("v")).alias("v"))


# --- further reports ----------------------------------------------------------------------------------------------


@query(
    r"""SELECT file_name, family, record_id, regexp_extract(sequence, '^>([^\r\n]*)', 1) AS header FROM (SELECT *, row_number() OVER (PARTITION BY file_name, family ORDER BY record_id) AS k FROM
 (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) AS rn FROM cm_fasta) WHERE rn = 1 AND fmt = 'fasta') WHERE k = 1"""
)
def s3_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each file, which stands for the wild type."""
    raw = last_delivery(table(spark, sf_dir, "cm_fasta"), "record_id", keep=["family", "file_name", "fmt", "sequence"]).where("fmt = 'fasta'")
    first = raw.groupBy("file_name", "family").agg(F.min_by(F.struct("record_id", "sequence"), "record_id").alias("m"))
    return first.select("file_name", "family", "m.record_id", F.regexp_extract("m.sequence", r"^>([^\r\n]*)", 1).alias("header"))


@query(f"WITH {LONG}, m AS (SELECT family, split, count(*) AS total FROM r WHERE split IS NOT NULL GROUP BY ALL) SELECT family, split, pos, state, round(count(*) / any_value(total) + 1e-10, 6) + 0.0 AS f FROM x JOIN m USING (family, split) GROUP BY family, split, pos, state")
def a6_split_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the states in each split, in one pass over all of its rows."""
    r = rows(spark, sf_dir).where("split is not null")
    n = r.groupBy("family", "split").agg(F.count("*").alias("total"))
    s = A.long(r, "family", "split").groupBy("family", "split", "pos", "state").agg(F.count("*").alias("n"))
    return s.join(n, ["family", "split"]).select("family", "split", "pos", "state", rounded(F.col("n") / F.col("total")).alias("f"))


@query(
    f"""WITH {ROWS}, k AS (SELECT family, seq_id, row_number() OVER (PARTITION BY family ORDER BY {DRAW.format(chr(39) + 'split:' + chr(39) + ' || seq_id')}, seq_id) <= floor(count(*) OVER (PARTITION BY family) * 0.8::DOUBLE) AS t FROM r)
 SELECT family, seq_id FROM k WHERE NOT t"""
)
def j8_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not in the drawn Train part."""
    r = rows(spark, sf_dir).select("family", "seq_id")
    return r.join(A.in_train(r).where("is_train"), "seq_id", "left_anti").select("family", "seq_id")


@query(
    f"""WITH {_REF}, {TOTAL}, i AS (SELECT family, seq_id, states, row_number() OVER (PARTITION BY family ORDER BY seq_id) - 1 AS k FROM r), q AS (SELECT family, total, rep FROM t, n),
 a AS (SELECT 'natural' AS grp, q.family, rep, CAST(list_sum(states) AS BIGINT) AS state_sum FROM q JOIN i ON i.family = q.family AND i.k = {DRAW.format("'boot:' || q.family || ':' || rep")} % total),
 b AS (SELECT 'random' AS grp, family, rep, CAST(sum(CASE WHEN state > 0 THEN {DRAW.format("'random:' || family || ':' || rep || ':' || pos")} % 20 + 1 ELSE 0 END) AS BIGINT) AS state_sum FROM z, n GROUP BY family, rep),
 c AS (SELECT 'shuffled' AS grp, family, rep, CAST(sum(state) AS BIGINT) AS state_sum FROM z, n GROUP BY family, rep) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""
)
def r7_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All control groups of each family in one table: rows drawn, random and shuffled, with the sum of their states."""
    r = rows(spark, sf_dir)
    ref = A.first_rows(r)
    natural = A.bootstrap(r, 20).join(r.select("seq_id", A.state_sum(F.col("states")).alias("state_sum")), "seq_id")
    total = lambda x: x.groupBy("family", "rep").agg(F.sum(F.col("state").cast("long")).alias("state_sum"))
    parts = [natural.select(F.lit("natural").alias("grp"), "family", "rep", "state_sum")]
    for name, x in (("random", A.random_rows(ref, 20)), ("shuffled", A.shuffled_rows(ref, 20))):
        parts.append(total(x).select(F.lit(name).alias("grp"), "family", "rep", "state_sum"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {DENSE}, m AS (SELECT family, seq_id, len(states) AS w FROM r), z AS (SELECT family, seq_id, CAST(unnest(range(w)) AS INTEGER) AS pos FROM m), q AS (SELECT family, seq_id, pos, CAST({DRAW.format("'baseline:' || seq_id || ':' || pos")} % 21 AS INTEGER) AS state FROM z)
 SELECT family, seq_id, round(-sum(ln(f)) + 1e-10, 6) + 0.0 AS energy FROM q JOIN d USING (family, pos, state) GROUP BY ALL"""
)
def r8_random_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of uniformly drawn rows, one for each row, as a baseline."""
    r = rows(spark, sf_dir)
    drawn = A.long(r, "family", "seq_id").select("family", "seq_id", "pos", (A.draw("baseline", "seq_id", "pos") % A.Q).cast("int").alias("state"))
    h = P.profile_fields(dense(r))
    return drawn.join(h, ["family", "pos", "state"]).groupBy("family", "seq_id").agg(rounded(-F.sum("v")).alias("energy"))


_SPLITS = f"""{ROWS}, cn AS (SELECT family, split, count(*) AS n FROM r WHERE split IS NOT NULL GROUP BY ALL), mn AS (SELECT family, min(n) AS m FROM cn GROUP BY family),
 rs AS (SELECT family, split, seq_id, states FROM (SELECT r.*, m, row_number() OVER (PARTITION BY family, split ORDER BY {DRAW.format(chr(39) + 'sample:' + chr(39) + ' || seq_id')}, seq_id) AS k FROM r JOIN mn USING (family) WHERE split IS NOT NULL) WHERE k <= m),
 x AS (SELECT family, split, seq_id, CAST(unnest(range(len(states))) AS INTEGER) AS pos, unnest(states) AS state FROM rs), s AS (SELECT family, split, pos, state, count(*)::DOUBLE / m AS f FROM x JOIN mn USING (family) GROUP BY family, split, pos, state, m),
 g AS (SELECT l.family, l.split, l.pos AS i, l.state AS a, k.pos AS j, k.state AS b, count(*)::DOUBLE / m AS f FROM x l JOIN x k ON l.seq_id = k.seq_id AND l.pos < k.pos JOIN mn ON mn.family = l.family GROUP BY l.family, l.split, l.pos, l.state, k.pos, k.state, m)"""


@query(
    f"""WITH {_SPLITS}, u AS (SELECT family, split, pos, sum(f * f) AS u FROM s GROUP BY ALL), mm AS (SELECT g.family, g.split, i, j, sum(g.f * g.f - 2 * g.f * l.f * k.f) AS v FROM g JOIN s l ON l.family = g.family AND l.split = g.split AND l.pos = i AND l.state = a
 JOIN s k ON k.family = g.family AND k.split = g.split AND k.pos = j AND k.state = b GROUP BY ALL) SELECT mm.family, mm.split, i, j, round(sqrt(greatest(v + l.u * k.u, 0)) + 1e-10, 5) + 0.0 AS strength FROM mm JOIN u l ON l.family = mm.family AND l.split = mm.split AND l.pos = i
 JOIN u k ON k.family = mm.family AND k.split = mm.split AND k.pos = j"""
)
def a6_equal_split_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly each two columns vary together in each split, as many rows of each split as the smallest has, all in one pass."""
    r = rows(spark, sf_dir).where("split is not null")
    m = r.groupBy("family", "split").agg(F.count("*").alias("n")).groupBy("family").agg(F.min("n").alias("m"))
    part = A.subsample(r, m, "split", on=["family"]).select(F.concat_ws("\t", "family", "split").alias("part"), "seq_id", "states")
    x = N.block_strength(part, group="part").withColumn("_p", F.split("part", "\t"))
    return x.select(F.col("_p")[0].alias("family"), F.col("_p")[1].alias("split"), "i", "j", rounded(F.col("strength"), 5).alias("strength"))


@query(
    f"""WITH {CELLS}, {WIDTH}, o AS (SELECT g.*, row_number() OVER (PARTITION BY g.family ORDER BY n DESC, i, j, a, b) AS k, floor(n_cols * n_cols * 441 / 2 * (1 - 95 / 100.0::DOUBLE) + 1e-9) AS most FROM g JOIN w USING (family))
 SELECT family, i, j, count(*) AS n_kept, CAST(sum(a * 21 + b) AS BIGINT) AS code_sum FROM o WHERE k <= most GROUP BY ALL"""
)
def t3_frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that occur and are left when the 95 percent of least frequency are pruned, over all columns: by pair of columns their number and the sum of their codes."""
    return N.kept_by_pair(rows(spark, sf_dir), N.shares, 95)


@query(f"WITH {DENSE}, h AS (SELECT family, pos, state, ln(f) - avg(ln(f)) OVER (PARTITION BY family, pos) AS v FROM d) SELECT family, round(avg(v) + 1e-10, 6) + 0.0 AS h_norm FROM h WHERE state = 1 GROUP BY family")
def a11_fields_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the gauged fields of state 1, as recorded in training without couplings."""
    h = P.profile_fields(dense(rows(spark, sf_dir)))
    h = h.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("family", "pos")))
    return h.where("state = 1").groupBy("family").agg(rounded(F.avg("v")).alias("h_norm"))


@query(
    f"""WITH {LONG}, q AS (SELECT family, sum(CAST(state > 0 AS INTEGER))::DOUBLE AS u, sum(state)::DOUBLE AS z, count(*) AS rep FROM x GROUP BY family, seq_id), o AS (SELECT family, u, z, count(*) AS c FROM q GROUP BY family, u, z),
 m AS (SELECT family, count(*) AS n, var_samp(u) AS vu, var_samp(z) AS vz, covar_samp(u, z) AS uz FROM q GROUP BY family), k AS (SELECT *, pow(n::DOUBLE, -1.0 / 3) AS s, vu * vz - uz * uz AS det FROM m WHERE n > 2)
 SELECT a.family, a.u, a.z, round(sum(b.c * exp(-0.5 / s * (vz * pow(a.u - b.u, 2) - 2 * uz * (a.u - b.u) * (a.z - b.z) + vu * pow(a.z - b.z, 2)) / det)) / any_value(n * 2 * pi() * s * sqrt(det)) * 1e6 + 1e-10, 3) + 0.0 AS density
 FROM o a JOIN o b ON a.family = b.family JOIN k ON k.family = a.family WHERE det > 1e-9 GROUP BY a.family, a.u, a.z"""
)
def a18_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian density (full covariance, Scott's width) of residues and published length at each point that occurs, per million.

    Equal points are one with their number, so the pairs are those of
    distinct points, of which a family has a bounded number.
    """
    r = rows(spark, sf_dir)
    q = r.select("family", A.residues(F.col("states")).cast("double").alias("u"), A.state_sum(F.col("states")).cast("double").alias("z"))
    o = q.groupBy("family", "u", "z").agg(F.count("*").alias("c"))
    m = q.groupBy("family").agg(F.count("*").alias("n"), F.var_samp("u").alias("vu"), F.var_samp("z").alias("vz"), F.covar_samp("u", "z").alias("uz")).where("n > 2")
    k = m.withColumns({"s": F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3)), "det": F.col("vu") * F.col("vz") - F.col("uz") * F.col("uz")}).where("det > 1e-9")
    b = o.select("family", F.col("u").alias("u2"), F.col("z").alias("z2"), F.col("c").alias("c2"))
    du, dz = F.col("u") - F.col("u2"), F.col("z") - F.col("z2")
    e = F.exp(-0.5 / F.col("s") * (F.col("vz") * du * du - 2 * F.col("uz") * du * dz + F.col("vu") * dz * dz) / F.col("det"))
    pairs = o.join(k, "family").join(b, "family")
    total = pairs.groupBy("family", "u", "z", "n", "s", "det").agg(F.sum(F.col("c2") * e).alias("t"))
    return total.select("family", "u", "z", rounded(F.col("t") / (F.col("n") * 2 * F.pi() * F.col("s") * F.sqrt("det")) * 1e6, 3).alias("density"))


@query(
    f"""WITH {_PHI_CELLS}, u AS (SELECT family, pos, sum(pow(o.phi * s.n / total, 2)) AS u FROM s JOIN o USING (family, pos, state) JOIN t USING (family) WHERE state > 0 GROUP BY ALL),
 m AS (SELECT g.family, i, j, sum(pow(lo.phi * ko.phi, 2) * (pow(g.n::DOUBLE / total, 2) - 2 * (g.n::DOUBLE / total) * (l.n::DOUBLE / total) * (k.n::DOUBLE / total))) AS m FROM g JOIN t USING (family) JOIN s l ON l.family = g.family AND l.pos = i AND l.state = a
 JOIN s k ON k.family = g.family AND k.pos = j AND k.state = b JOIN o lo ON lo.family = g.family AND lo.pos = i AND lo.state = a JOIN o ko ON ko.family = g.family AND ko.pos = j AND ko.state = b WHERE a > 0 AND b > 0 GROUP BY ALL)
 SELECT m.family, i, j, round(sqrt(greatest(m + l.u * k.u, 0)) + 1e-10, 4) + 0.0 AS norm FROM m JOIN u l ON l.family = m.family AND l.pos = i JOIN u k ON k.family = m.family AND k.pos = j"""
)
def a7_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of the weighted correlations of two columns, gaps left out; pairs of which no two residues occur together are left out."""
    r = rows(spark, sf_dir)
    values = _conserved(r, 1)
    x = N.by_pair(r, lambda n, g: {"norm": np.sqrt((values(n, g) ** 2).sum(axis=(1, 2))), "some": n[:, 1:, 1:].sum(axis=(1, 2)) > 0}, "norm double, some boolean").where("some")
    return x.select("family", "i", "j", rounded(F.col("norm"), 4).alias("norm"))


@query(
    f"""WITH {CELLS}, e AS (SELECT g.family, corr(g.n::DOUBLE / total, (l.n::DOUBLE / total) * (k.n::DOUBLE / total)) AS z FROM g JOIN t USING (family) JOIN s l ON l.family = g.family AND l.pos = i AND l.state = a JOIN s k ON k.family = g.family AND k.pos = j AND k.state = b
 GROUP BY g.family HAVING count(*) > 2 AND stddev_pop(g.n::DOUBLE / total) * stddev_pop((l.n::DOUBLE / total) * (k.n::DOUBLE / total)) > 1e-15) SELECT family, round(z + 1e-10, 6) + 0.0 AS pearson FROM e"""
)
def a15_pair_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the pair frequencies that occur follow from the single ones."""

    def values(n: np.ndarray, _: str) -> dict[str, np.ndarray]:
        p, there = N.shares(n), n > 0
        q = p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True) * there
        total = lambda x: x.sum(axis=(1, 2))
        return {"c": total(there), "l": total(p), "k": total(q), "ll": total(p * p), "kk": total(q * q), "lk": total(p * q)}

    x = N.by_pair(rows(spark, sf_dir), values, "c long, l double, k double, ll double, kk double, lk double")
    x = x.groupBy("family").agg(*[F.sum(c).alias(c) for c in ("c", "l", "k", "ll", "kk", "lk")])
    mean = lambda c: F.col(c) / F.col("c")
    sd = lambda c: F.sqrt(F.greatest(mean(c + c) - mean(c) * mean(c), F.lit(0.0)))
    x = x.withColumn("sd", sd("l") * sd("k")).where("c > 2 and sd > 1e-15")
    return x.select("family", rounded((mean("lk") - mean("l") * mean("k")) / F.col("sd")).alias("pearson"))
