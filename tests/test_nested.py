import json
import math
import re

from seqloom.operators import nested as N

LISTS = ["scores", "extra_residue_counts"]
NUMBER = re.compile(N.NUMBER)


def brute(payload):
    """Elements of one payload that are finite: (group, list, position)."""
    try:
        o = json.loads(payload) if payload is not None else None
    except ValueError:
        return []
    if not isinstance(o, dict):
        return []
    out = []
    inner = o.get("result")
    for groups in (o.get("groups"), inner.get("groups") if isinstance(inner, dict) else None):
        named = groups.items() if isinstance(groups, dict) else [(g.get("name"), g) for g in groups if isinstance(g, dict)] if isinstance(groups, list) else []
        for name, g in named:
            parts = [(0, g)] + [(c.get("offset", 0) or 0, c) for c in (g.get("chunks") or []) if isinstance(c, dict)]
            for start, part in parts:
                for n in LISTS:
                    for k, v in enumerate(part.get(n) or []):
                        if isinstance(v, bool):
                            continue
                        if isinstance(v, str):
                            v = float(v) if NUMBER.match(v) else None
                        if isinstance(v, (int, float)) and math.isfinite(v):
                            out.append((name, n, start + k))
    return sorted(out)


PAYLOADS = [
    None,
    "",
    "null",
    "[1, 2]",
    '{"groups": {"a": {"scores": [1, 2',
    '{"groups": {"a": {"scores": [1]}}} x',
    '{"groups": {"a": {"scores": [1.5, NaN, -Infinity, null, "2.5", "x", true, "1e3", "3d", ""], "extra_residue_counts": null}}}',
    '{"result": {"groups": [{"name": "b", "scores": [], "chunks": [{"offset": 3, "scores": ["7"], "extra_residue_counts": [1, 2]}, {"offset": 0, "scores": [1, 2, 3]}]}]}}',
    '{"groups": null, "other": {"deep": [[1, 2], [3]]}}',
    '{"groups": {}}',
    '{"groups": {"a": {"scores": [1]}, "a": {"scores": [2, " 3 "]}}, "result": {"groups": {"a": {"scores": ["4"]}}}}',
    '{"groups": {"a": {"name": "z", "scores": [0]}, "with \\"sign\\"": {"scores": [1]}}, "row_key": 5, "body": {"x": 1}}',
]


def elements(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "sweep_id long, payload string")
    tables = N.flatten(df, "sweep_id", "payload", {"group": ["groups", "result.groups"]})
    found = N.list_elements(tables, "group", LISTS).selectExpr("cast(parent_key as long) k", "entry_name grp", "list_name", "idx", "text")
    out = {}
    for r in found.withColumn("v", N.finite("text")).where("v is not null").collect():
        out.setdefault(r["k"], []).append((r["grp"], r["list_name"], r["idx"]))
    return tables, {k: sorted(v) for k, v in out.items()}


def test_elements_equal_brute_force(spark):
    _, got = elements(spark, PAYLOADS)
    assert got == {k: b for k, p in enumerate(PAYLOADS) if (b := brute(p))}


def test_tables_keep_parents_and_order(spark):
    tables, _ = elements(spark, PAYLOADS)
    keys = {r["row_key"] for r in tables["group"].collect()}
    chunks = tables["group.chunks"].collect()
    assert chunks and all(r["parent_key"] in keys for r in chunks)
    deep = {(r["parent_key"], r["ordinal"]) for r in tables["other.deep"].collect()}
    assert deep == {("8", 0), ("8", 1)}
    assert tables[""].count() == len(PAYLOADS)


def test_one_element_in_each_of_two_places_gives_two_rows(spark):
    tables, got = elements(spark, ['{"groups": {"a": {"scores": [1]}}, "result": {"groups": {"a": {"scores": [2]}}}}'])
    assert got == {0: [("a", "scores", 0)] * 2}
    keys = [r["row_key"] for r in tables["group"].collect()]
    assert len(set(keys)) == 2


def test_every_level_of_arrays_has_its_table(spark):
    deep = 0
    for k in range(9):
        deep = {f"l{9 - k}": [deep, None, 3]}
    tables = N.flatten(spark.createDataFrame([(1, json.dumps(deep)), (2, '{"l1": 3}'), (3, "[[1], [[2]]]")], "k long, p string"), "k", "p")
    names = [".".join(f"l{i}" for i in range(1, n + 1)) for n in range(1, 10)]
    assert set(names) <= set(tables)
    inner = tables[names[-1]].collect()
    assert [r["ordinal"] for r in sorted(inner, key=lambda r: r["ordinal"])] == [0, 1, 2]
    assert {r["parent_key"] for r in inner} <= {r["row_key"] for r in tables[names[-2]].collect()}


def test_empty_table_and_clashing_columns(spark):
    tables, got = elements(spark, [])
    assert got == {} and tables[""].count() == 0
    df = spark.createDataFrame([(1, '{"row_key": {"ordinal": 2}, "a": [1]}', "x")], "k long, p string, body string")
    tables = N.flatten(df, "k", "p")
    assert tables[""].first()["f.row_key.ordinal"] == 2 and tables["a"].count() == 1


def test_given_tables_at_small_scale(spark):
    from seqloom.plans.problems import p1_found

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/mpnn_scores.parquet").select("sweep_id", "loaded_at", "payload").collect()
    last = {}
    for r in rows:
        if r["sweep_id"] not in last or (r["loaded_at"], r["payload"] or "") > (last[r["sweep_id"]]["loaded_at"], last[r["sweep_id"]]["payload"] or ""):
            last[r["sweep_id"]] = r
    want = sorted((k, *e) for k, r in last.items() for e in brute(r["payload"]))
    assert sorted(tuple(r) for r in p1_found(spark, d).collect()) == want
