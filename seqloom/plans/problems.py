"""Queries of the general data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import drift as D
from seqloom.operators import nested as N
from seqloom.session import last_delivery, table
from seqloom.sources.records import load_records, recovered_records, syntax_errors

GROUPS = {"group": ["groups", "result.groups"]}
LISTS = ["scores", "extra_residue_counts"]
HOLDERS, NAMED = ["options", "options0", "options1"], ["n_states"]


def _score_tables(spark: SparkSession, sf_dir: str) -> N.Tables:
    last = last_delivery(table(spark, sf_dir, "mpnn_scores"), "sweep_id", keep=["payload"])
    return N.flatten(last, "sweep_id", "payload", GROUPS)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.list_elements(_score_tables(spark, sf_dir), "group", LISTS)
    return out.select(F.col(N.PARENT).cast("long").alias("sweep_id"), F.col(N.NAME).alias("grp"), "list_name", "idx", N.finite("text").alias("value"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the score lists that are finite numbers."""
    return _elements(spark, sf_dir).where("value is not null").select("sweep_id", "grp", "list_name", "idx")


def p1_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of list elements, with their values."""
    return _elements(spark, sf_dir)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of groups, with their place in their sweep."""
    tables = _score_tables(spark, sf_dir)
    if "group" not in tables:
        return spark.createDataFrame([], "sweep_id long, row_key string, ordinal int, grp string, kind string, temperature double")
    groups = tables["group"]
    have = set(groups.columns)
    get = lambda c, t: (F.col(f"`f.{c}`") if f"f.{c}" in have else F.lit(None)).cast(t).alias(c)
    return groups.select(F.col(N.PARENT).cast("long").alias("sweep_id"), N.KEY, N.ORDINAL, F.col(N.NAME).alias("grp"), get("kind", "string"), get("temperature", "double"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_delivery(table(spark, sf_dir, "cm_fasta"), "record_id", keep=["family", "fmt", "sequence"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_records(_raw(spark, sf_dir), table(spark, sf_dir, "families"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can't be loaded, with the reason."""
    return _records(spark, sf_dir).where("reason is not null").select("record_id", "reason")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records loaded as alignment rows."""
    return _records(spark, sf_dir).where("reason is null").select("record_id", "family", "header", "states")


def p2_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every syntax error with its place."""
    return syntax_errors(_raw(spark, sf_dir))


def p2_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can be read in texts with errors."""
    return recovered_records(_raw(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_delivery(table(spark, sf_dir, "model_npy"), "model_id", keep=["series_id", "file_no", *HOLDERS, *NAMED])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options added, removed, renamed or retyped from file to file."""
    return D.drift(_files(spark, sf_dir), "model_id", "series_id", "file_no", HOLDERS, NAMED)


def p3_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All options in one consistent table, each value in the branch of its type."""
    opts = D.options(_files(spark, sf_dir), "model_id", HOLDERS, NAMED)
    return D.branched(opts)


def p3_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged union of each option's types."""
    opts = D.options(_files(spark, sf_dir), "model_id", HOLDERS, NAMED)
    return D.fused_schema(opts)


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged union of each path's types, however deep it lies."""
    return D.fused_schema(D.paths(D.options(_files(spark, sf_dir), "model_id", HOLDERS, NAMED)), "path")


def p3_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of each path of each series, and the file in which it first appeared."""
    return D.alternatives(_files(spark, sf_dir), "model_id", "series_id", "file_no", HOLDERS, NAMED)


QUERIES = {f.__name__: f for f in (p1_found, p1_elements, p1_groups, p2_found, p2_loaded, p2_errors, p2_recovered, p3_found, p3_options, p3_types, p3_paths, p3_alternatives)}
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY loaded_at DESC) AS rn FROM {0}) WHERE rn = 1)"

# DuckDB reads no bare NaN or Infinity; as neither counts, null stands for them
_BARE = r"'([\[,:]\s*)(?:[-]?Infinity|NaN)(\s*[,\]}])', '\1null\2', 'g'"
_ELEMENTS_SQL = rf"""WITH q AS (SELECT sweep_id, regexp_replace(regexp_replace(payload, {_BARE}), {_BARE}) AS p FROM {_LAST.format("mpnn_scores", "sweep_id")}), v AS (SELECT sweep_id, CAST(p AS JSON) AS p FROM q WHERE p IS NOT NULL AND json_valid(p)),
 gs AS (SELECT sweep_id, json_extract(p, '$.groups') AS g FROM v UNION ALL SELECT sweep_id, json_extract(p, '$.result.groups') AS g FROM v),
 g AS (SELECT sweep_id, k AS grp, json_extract(g, '$."' || k || '"') AS body FROM (SELECT sweep_id, g, unnest(json_keys(g)) AS k FROM gs WHERE json_type(g) = 'OBJECT')
 UNION ALL SELECT sweep_id, json_extract_string(e, '$.name') AS grp, e AS body FROM (SELECT sweep_id, unnest(CAST(g AS JSON[])) AS e FROM gs WHERE json_type(g) = 'ARRAY')),
 n AS (SELECT unnest(['scores', 'extra_residue_counts']) AS list_name), c AS (SELECT sweep_id, grp, unnest(CAST(json_extract(body, '$.chunks') AS JSON[])) AS ch FROM g WHERE json_type(json_extract(body, '$.chunks')) = 'ARRAY'),
 l AS (SELECT sweep_id, grp, list_name, 0 AS o, json_extract(body, '$.' || list_name) AS a FROM g, n UNION ALL SELECT sweep_id, grp, list_name, CAST(json_extract(ch, '$.offset') AS INTEGER) AS o, json_extract(ch, '$.' || list_name) AS a FROM c, n),
 e AS (SELECT sweep_id, grp, list_name, CAST(o + unnest(range(CAST(json_array_length(a) AS BIGINT))) AS INTEGER) AS idx, unnest(CAST(a AS JSON[])) AS z FROM l WHERE json_type(a) = 'ARRAY'),
 d AS (SELECT sweep_id, grp, list_name, idx, CASE WHEN json_type(z) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') OR (json_type(z) = 'VARCHAR' AND regexp_full_match(json_extract_string(z, '$'), '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*'))
 THEN TRY_CAST(json_extract_string(z, '$') AS DOUBLE) END AS value FROM e)"""

_GROUPS_SQL = rf"""WITH q AS (SELECT sweep_id, regexp_replace(regexp_replace(payload, {_BARE}), {_BARE}) AS p FROM {_LAST.format("mpnn_scores", "sweep_id")}), v AS (SELECT sweep_id, CAST(p AS JSON) AS p FROM q WHERE p IS NOT NULL AND json_valid(p)),
 gs AS (SELECT sweep_id, 'groups' AS place, json_extract(p, '$.groups') AS g FROM v UNION ALL SELECT sweep_id, 'result.groups' AS place, json_extract(p, '$.result.groups') AS g FROM v),
 g AS (SELECT sweep_id, place, k AS grp, row_number() OVER (PARTITION BY sweep_id, place ORDER BY k) - 1 AS ordinal, json_extract(g, '$."' || k || '"') AS body FROM (SELECT sweep_id, place, g, unnest(json_keys(g)) AS k FROM gs WHERE json_type(g) = 'OBJECT')
 UNION ALL SELECT sweep_id, place, json_extract_string(e, '$.name') AS grp, ordinal, e AS body FROM (SELECT sweep_id, place, unnest(range(CAST(json_array_length(g) AS BIGINT))) AS ordinal, unnest(CAST(g AS JSON[])) AS e FROM gs WHERE json_type(g) = 'ARRAY'))
 SELECT sweep_id, sweep_id || '/' || place || '/' || ordinal AS row_key, CAST(ordinal AS INTEGER) AS ordinal, grp, json_extract_string(body, '$.kind') AS kind, TRY_CAST(json_extract_string(body, '$.temperature') AS DOUBLE) AS temperature FROM g"""

_FIELD = r"""(?:"(?:[^"]|"")*"|[^",\r\n]*)"""
_CSV_ROW = f"{_FIELD}(?:,{_FIELD})*"
_REASONS = f"""WITH k AS {_LAST.format("cm_fasta", "record_id")}, b AS (SELECT record_id, family, fmt, sequence AS s, CASE WHEN fmt = 'csv' THEN regexp_extract(sequence, '^({_FIELD}),({_FIELD})(?:\r\n|\r|\n)?$', 2) ELSE regexp_replace(sequence, '^[^\r\n]*', '') END AS body FROM k),
 c AS (SELECT *, CASE WHEN fmt <> 'csv' AND NOT (s LIKE '>%' AND len(regexp_extract_all(s, '(?:^|[\r\n])>')) = 1) THEN 'header' WHEN fmt = 'csv' AND NOT regexp_full_match(s, '{_CSV_ROW}(?:(?:\r\n|\r|\n){_CSV_ROW})*') THEN 'quoting'
 WHEN fmt = 'csv' AND NOT regexp_full_match(s, '{_FIELD},{_FIELD}(?:\r\n|\r|\n)?') THEN 'columns' END AS syntax,
 regexp_replace(CASE WHEN body LIKE '"%' THEN replace(substr(body, 2, length(body) - 2), '""', '"') ELSE body END, '[\r\n \t]', '', 'g') AS q FROM b),
 d AS (SELECT record_id, c.family, CASE WHEN syntax IS NOT NULL THEN syntax WHEN c.q = '' THEN 'empty' WHEN NOT regexp_full_match(c.q, '[ACDEFGHIKLMNPQRSTVWY-]+') THEN 'symbol' WHEN length(c.q) IS DISTINCT FROM n_cols THEN 'length' END AS reason FROM c LEFT JOIN families f ON f.family = c.family)"""

_HEADER = r"""CASE WHEN c.fmt <> 'csv' THEN substr(regexp_extract(c.s, '^[^\r\n]*'), 2) WHEN c.s LIKE '"%' THEN replace(regexp_extract(c.s, '^"((?:[^"]|"")*)"', 1), '""', '"') ELSE regexp_extract(c.s, '^[^,]*') END AS header"""
_LOADED_SQL = _REASONS.replace("SELECT record_id, c.family, CASE", f"SELECT record_id, c.family, c.q, {_HEADER}, CASE") + """
 SELECT record_id, family, header, list_transform(string_split(q, ''), lambda z: CAST(instr('-ACDEFGHIKLMNPQRSTVWY', z) - 1 AS INTEGER)) AS states FROM d WHERE reason IS NULL"""

_OPTIONS_SQL = f"""WITH k AS {_LAST.format("model_npy", "model_id")}, h AS (SELECT model_id, unnest([options, options0, options1]) AS h FROM k), o AS (SELECT model_id, name, any_value(v) AS v FROM
 (SELECT model_id, name, CAST(json(json_extract(h, '$."' || name || '"')) AS VARCHAR) AS v FROM (SELECT model_id, h, unnest(json_keys(h)) AS name FROM h WHERE h IS NOT NULL) UNION ALL SELECT model_id, 'n_states' AS name, CAST(json(n_states) AS VARCHAR) AS v FROM k WHERE n_states IS NOT NULL) GROUP BY ALL),
 y AS (SELECT *, CASE json_type(CAST(v AS JSON)) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS tag FROM o)"""

SQL: dict[str, str] = {
    "p1_found": f"{_ELEMENTS_SQL} SELECT sweep_id, grp, list_name, idx FROM d WHERE value IS NOT NULL AND isfinite(value)",
    "p1_elements": f"{_ELEMENTS_SQL} SELECT sweep_id, grp, list_name, idx, CASE WHEN isfinite(value) THEN value END AS value FROM d",
    "p1_groups": _GROUPS_SQL,
    "p2_found": f"{_REASONS} SELECT record_id, reason FROM d WHERE reason IS NOT NULL",
    "p2_loaded": _LOADED_SQL,
    "p3_found": f"""{_OPTIONS_SQL}, l AS (SELECT model_id, lag(model_id) OVER (PARTITION BY series_id ORDER BY file_no) AS prev FROM k WHERE coalesce(options, options0, options1, n_states) IS NOT NULL),
 n AS (SELECT model_id, name, max(t1) AS t1, max(t0) AS t0, max(v1) AS v1, max(v0) AS v0 FROM (SELECT l.model_id, name, tag AS t1, NULL AS t0, v AS v1, NULL AS v0 FROM l JOIN y USING (model_id) WHERE prev IS NOT NULL
 UNION ALL SELECT l.model_id, name, NULL AS t1, tag AS t0, NULL AS v1, v AS v0 FROM l JOIN y ON y.model_id = l.prev) GROUP BY ALL),
 a AS (SELECT model_id, name, v1 AS v, t1, row_number() OVER (PARTITION BY model_id, v1 ORDER BY name) AS r FROM n WHERE t0 IS NULL), b AS (SELECT model_id, name, v0 AS v, row_number() OVER (PARTITION BY model_id, v0 ORDER BY name) AS r FROM n WHERE t1 IS NULL),
 m AS (SELECT coalesce(a.model_id, b.model_id) AS model_id, coalesce(b.name, '') AS old_name, coalesce(a.name, '') AS new_name FROM a FULL JOIN b ON a.model_id = b.model_id AND a.v = b.v AND a.r = b.r AND a.v <> 'null')
 SELECT model_id, old_name, new_name, CASE WHEN old_name = '' THEN 'added' WHEN new_name = '' THEN 'removed' ELSE 'renamed' END AS change FROM m
 UNION ALL SELECT model_id, name AS old_name, name AS new_name, 'retyped' AS change FROM n WHERE t0 <> t1 AND t0 <> 'null' AND t1 <> 'null'""",
    "p3_types": f"""{_OPTIONS_SQL} SELECT name, {", ".join(f"count(*) FILTER (tag = '{t}') AS n_{t}" for t in (*D.BRANCHES, "null"))}, count(*) AS n_values FROM y GROUP BY name""",
}
