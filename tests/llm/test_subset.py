import itertools

import numpy as np
import pandas as pd

from seqloom.llm import subset as B

SCHEMA = "seq_id long, family string, states array<int>, loaded_at timestamp, pivot int"


def cost(combos, units, n):
    """What ``solve`` minimises, from its definition."""
    subs = combos.groupby("subfamily")["count"].sum()
    target = n / len(subs)
    total = 0.0
    used = combos.assign(u=units)
    for s, g in used.groupby("subfamily"):
        u = g["u"].sum()
        total += sum(-0.01 * np.log(subs[s] + 1) + B.W_SUBFAMILY / max(target, 0.5) * k for k in range(u))
        for _, p in g.groupby("pivot"):
            u = p["u"].sum()
            total += sum(-0.001 * np.log(p["count"].sum() + 1) + B.W_PIVOT / max(target / g["pivot"].nunique(), 0.5) * k for k in range(u))
    usual = used[used["class"] < B.COPY].groupby("class")["count"].sum()
    for c, g in used.groupby("class"):
        u = g["u"].sum()
        total += u * B.LAST_RESORT[c] if c in B.LAST_RESORT else sum(B.W_CLASS / max(n * np.sqrt(usual[c]) / np.sqrt(usual).sum(), 0.5) * k for k in range(u))
    return total


def test_flow_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(12):
        combos = pd.DataFrame([(s, 2 * s + p, c, int(rng.integers(1, 4))) for s in range(2) for p in range(2) for c in (0, 2, B.COPY) if rng.random() < 0.6], columns=["subfamily", "pivot", "class", "count"])
        n = min(4, combos["count"].sum()) if len(combos) else 0
        if not n:
            continue
        got = B.solve(combos, n).to_numpy()
        assert got.sum() == n and (got <= combos["count"]).all()
        best = min(cost(combos, np.array(u), n) for u in itertools.product(*[range(c + 1) for c in combos["count"]]) if sum(u) == n)
        assert cost(combos, got, n) <= best + 1e-6


def rows(spark):
    rng = np.random.default_rng(2)
    heads = rng.integers(1, 21, (4, 60))
    data = []
    for k, n in enumerate((300, 20, 8, 3)):
        for _ in range(n):
            s = np.where(rng.random(60) < 0.25, rng.integers(0, 21, 60), heads[k])
            data.append((len(data), "A", s.tolist(), None, 9))
    data += [(1000 + k, "A", data[0][2], None, 9) for k in range(50)]
    data += [(2000, "A", None, None, 9), (2001, "A", [0] * 60, None, 9), (2002, None, heads[0].tolist(), None, 9), (None, "A", heads[0].tolist(), None, 9)]
    data += [(4000, "A", [1, 2, 3] * 20_000, None, 9)]
    data += [(3000 + k, "B", (heads[0] if k < 2 else heads[1]).tolist(), None, 9) for k in range(3)] + [(3003, "B", None, None, 9)]
    return spark.createDataFrame(data, SCHEMA), data


def test_subset_covers_small_groups(spark):
    df, data = rows(spark)
    sizes = spark.createDataFrame([("A", 12), ("A", 5), ("B", 10), ("C", 4), ("D", None)], "family string, n_select int")
    got = B.varied_subset(df, sizes)["selected"].collect()
    a = [r["seq_id"] for r in got if r["family"] == "A"]
    assert len(a) == len(set(a)) == 12
    a = [k for k in a if k != 4000]
    kind = [0 if k < 300 else 1 if k < 320 else 2 if k < 328 else 3 for k in a]
    assert set(kind) == {0, 1, 2, 3} and kind.count(0) <= 6
    assert not [k for k in a if k >= 1000]
    assert sorted(r["seq_id"] for r in got if r["family"] == "B") == [3000, 3001, 3002, 3003]
    again = B.varied_subset(df.repartition(3), sizes)["selected"].collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_rows_of_any_width_are_compared_whole(spark):
    rng = np.random.default_rng(3)
    heads = rng.integers(1, 21, (4, 5_000))
    heads[:, :4_000] = heads[0, :4_000]
    heads[1:, :4_000] = 0  # alike, or empty, in all but their last columns
    data = []
    for k in range(30):
        s = np.where(rng.random(5_000) < 0.2, rng.integers(1, 21, 5_000), heads[0]) if k < 27 else heads[k - 26]
        data.append((k, "A", s.tolist(), None, 0))
    df = spark.createDataFrame(data, SCHEMA)
    got = B.varied_subset(df, spark.createDataFrame([("A", 4)], "family string, n_select int"))["selected"].collect()
    assert {27, 28, 29} < {r["seq_id"] for r in got} and len(got) == 4 and len({r["subfamily"] for r in got}) == 4


def test_joined_pivots_give_the_same(spark, monkeypatch):
    df, _ = rows(spark)
    df = df.where("seq_id <> 4000")
    sizes = spark.createDataFrame([("A", 12), ("B", 2)], "family string, n_select int")
    want = sorted(map(tuple, B.varied_subset(df, sizes)["selected"].collect()))
    monkeypatch.setattr(B, "MOST_LETTERS", 0)
    monkeypatch.setattr(B, "ROWS_A_TASK", 50)
    monkeypatch.setattr(B, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, B.varied_subset(df, sizes)["selected"].collect())) == want


def test_many_single_rows_are_found_round_after_round(spark):
    rng = np.random.default_rng(4)
    big = rng.integers(1, 21, 60)
    data = [(k, "A", np.where(rng.random(60) < 0.2, rng.integers(1, 21, 60), big).tolist(), None, 0) for k in range(3_000)]
    data += [(10_000 + k, "A", rng.integers(1, 21, 60).tolist(), None, 0) for k in range(150)]
    got = B.varied_subset(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([("A", 100)], "family string, n_select int"))
    assert sum(r["seq_id"] >= 10_000 for r in got["selected"].collect()) >= 95


def test_empty_tables(spark):
    df, _ = rows(spark)
    sizes = spark.createDataFrame([("A", 12)], "family string, n_select int")
    assert B.varied_subset(df.limit(0), sizes)["selected"].count() == 0
    assert B.varied_subset(df, sizes.limit(0))["selected"].count() == 0
