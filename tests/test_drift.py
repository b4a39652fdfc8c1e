import itertools
import json

from seqloom.operators import drift as D

SCHEMA = "model_id long, series_id long, file_no int, options string, options0 string, n_states string, change string"
FILES = [
    (1, 7, 1, '{"a": 1, "b": "x", "c": null}', None, "5", "clash"),
    (2, 7, 3, None, '{"a": "1", "B": "x", "n_states": 5}', None, None),
    (3, 7, 5, None, None, None, None),
    (4, 7, 9, '{"a": [1,  2], "q": {"k": 1}}', "not json", "null", None),
    (5, 7, 10, '{"z": [1,2], "q": {"k":1}, "d": null}', "[]", None, None),
    (6, 8, 2, "{}", None, None, None),
    (7, 8, 4, '{"m": true, "k": true}', None, None, None),
    (8, 8, 5, '{"u": true}', None, None, None),
    (9, None, 5, '{"u": true}', None, None, None),
]


def tag(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {str: "string", list: "array", dict: "object"}[type(v)]


def brute(files):
    out = []
    by = {}
    for m, s, n, a, b, c, _ in files:
        if s is None or (a is None and b is None and c is None):
            continue
        o = {}
        for h in (a, b):
            try:
                v = json.loads(h) if h else None
            except ValueError:
                v = None
            o |= v if isinstance(v, dict) else {}
        if c is not None:
            o["n_states"] = json.loads(c)
        by.setdefault(s, []).append((n, m, o))
    for files in by.values():
        for (_, _, x), (_, m, y) in itertools.pairwise(sorted(files, key=lambda f: f[0])):
            gone, come = sorted(set(x) - set(y)), sorted(set(y) - set(x))
            for g in list(gone):
                for c in come:
                    if x[g] is not None and json.dumps(x[g], sort_keys=True) == json.dumps(y[c], sort_keys=True):
                        out.append((m, g, c, "renamed"))
                        gone.remove(g)
                        come.remove(c)
                        break
            out += [(m, g, "", "removed") for g in gone] + [(m, "", c, "added") for c in come]
            out += [(m, k, k, "retyped") for k in x if k in y and "null" not in (tag(x[k]), tag(y[k])) and tag(x[k]) != tag(y[k])]
    return sorted(out)


def test_changes_equal_brute_force(spark):
    got = D.drift(spark.createDataFrame(FILES, SCHEMA), "model_id", "series_id", "file_no", ["options", "options0"], ["n_states"])
    assert sorted(tuple(r) for r in got.collect()) == brute(FILES)


def test_previous_file_over_blocks(spark):
    rows = [(k, 1, n) for k, n in enumerate([0, 3, 4, 9, 31, 32, 33, 100, 101])]
    df = spark.createDataFrame(rows, "k long, s long, n int")
    for block in (1, 4, 10, 4096):
        got = {r["k"]: r["previous"] for r in D.previous_file(df, "k", "s", "n", block).collect()}
        assert got == {k: k - 1 for k in range(1, len(rows))}


def test_alternatives_of_nested_paths(spark):
    files = [(1, 1, 1, '{"a": {"b": [1, {"c": null}]}}', None), (2, 1, 2, '{"a": {"b": ["x"], "d": 1}}', None), (3, 1, 5, '{"a": 3, "a": {"d": true}}', None), (4, None, 1, '{"z": 1}', None)]
    df = spark.createDataFrame(files, "k long, s long, n int, options string, q string")
    got = {(r["path"], r["tag"]): (r["n_files"], r["first_file"], r["appeared"]) for r in D.alternatives(df, "k", "s", "n", ["options"], ["q"]).collect()}
    assert got == {
        ("a", "object"): (3, 1, False), ("a.b", "array"): (2, 1, False), ("a.b[]", "number"): (1, 1, False), ("a.b[]", "object"): (1, 1, False), ("a.b[].c", "null"): (1, 1, False),
        ("a.b[]", "string"): (1, 2, True), ("a.d", "number"): (1, 2, False), ("a.d", "boolean"): (1, 3, True),
    }


def test_branches_and_canonical_values(spark):
    df = spark.createDataFrame([(1, '{"a": "590", "b": true, "c": [1], "d": {"x": 1}, "e": 2.5, "f": null, "g": "x\\"y"}', None)], "model_id long, options string, n_states string")
    rows = {r["name"]: r for r in D.branched(D.options(df, "model_id", ["options"], ["n_states"])).collect()}
    assert rows["a"]["as_string"] == "590" and rows["a"]["canonical_number"] == 590
    assert rows["b"]["as_boolean"] is True and rows["c"]["as_array"] == "[1]" and rows["d"]["as_object"] == '{"x":1}'
    assert rows["e"]["as_number"] == 2.5 and rows["f"]["canonical"] is None and rows["g"]["as_string"] == 'x"y'


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert D.drift(df, "model_id", "series_id", "file_no", ["options", "options0"], ["n_states"]).count() == 0
