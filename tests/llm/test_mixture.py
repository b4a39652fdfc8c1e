import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seqloom.llm import mixture as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="the tokenizer's file is not there")


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 60))
def test_knapsack_is_exact(counts, rest):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    got = M.knapsack(counts, rest)
    assert all(n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= rest)


DOCS = "doc_id long, text string, source string, n_tokens long, plan_name string"
PLANS = "plan_name string, source string, target_share double, max_repeats int, size_factor double, text string"


def docs(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for k in range(900):
        source = "Big-One" if k < 600 else "mid_two" if k < 860 else "small"
        rows.append((k, " ".join(words[(k * 7 + j) % 4] for j in range(5 + (k * 13) % 60)), source if k % 5 else f" {source.upper()} ", -1, "x"))
    rows += [(2000, None, "small", 0, None), (2001, "", "small", 0, None), (2002, "lost words", None, 0, None), (None, "no id", "small", 0, None), (1, "short", "big one", 0, None)]
    return spark.createDataFrame(rows, DOCS)


def run(spark, d, plans):
    out = M.mix(d, spark.createDataFrame([(*p, "x") for p in plans], PLANS))
    return {(r["plan_name"], r["source"]): r for r in out["report"].collect()}, out["selected"].collect()


def test_shares_caps_and_reports(spark):
    plans = [("a", "big one", 1.0, 2, 0.5), ("a", "MID-two", 1.0, 2, 0.5), ("b", "small", 0.5, 3, 1.0), ("b", "big_one", 0.5, None, 1.0), ("b", "absent", None, 1, None), ("c", "small", 0.0, 1, 1.0)]
    report, selected = run(spark, docs(spark), plans)
    for key in (("a", "big_one"), ("a", "mid_two"), ("b", "big_one")):
        assert report[key]["tokens"] == report[key]["target_tokens"]
    assert report["a", "big_one"]["share"] == pytest.approx(0.5, abs=1e-3)
    assert report["b", "small"]["tokens"] < report["b", "small"]["target_tokens"]
    assert {r["times"] for r in selected if r["plan_name"] == "b" and r["source"] == "small"} == {3}
    assert report["b", "absent"]["tokens"] == report["c", "small"]["tokens"] == 0
    assert len({(r["plan_name"], r["doc_id"]) for r in selected}) == len(selected)
    assert not {2000, 2001, 2002, None} & {r["doc_id"] for r in selected}
    _, again = run(spark, docs(spark).repartition(3), plans)
    assert sorted(map(tuple, again)) == sorted(map(tuple, selected))


def test_empty_tables(spark):
    plans = [("a", "big one", 1.0, 2, 0.5)]
    report, selected = run(spark, docs(spark).limit(0), plans)
    assert report["a", "big_one"]["tokens"] == 0 and not selected
    report, selected = run(spark, docs(spark), [])
    assert not report and not selected


def test_very_long_text(spark):
    df = spark.createDataFrame([("word " * 100_000,), (None,), ("",)], "t string").select(M.token_count(M.F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [100_001, 0, 0]


def test_budgets_of_long_and_very_unequal_documents_are_filled(spark):
    # distinct lengths of about 5,000 tokens; in the second source documents that are larger than what is left at their place
    rows = [(k, 4_000 + 4 * k, "long") for k in range(500)] + [(1_000 + k, 300 + k, "mixed") for k in range(1_500)] + [(3_000 + k, 700_000 + 50_000 * k, "mixed") for k in range(6)]
    d = spark.createDataFrame([(k, "word " * n, s) for k, n, s in rows], "doc_id long, text string, source string").repartition(16)
    plans = [(f"p{k}", s, 1.0, 1, f) for k, (s, f) in enumerate([("long", 0.05), ("long", 0.08), ("long", 0.13), ("mixed", 0.1), ("mixed", 0.15), ("mixed", 0.4), ("mixed", 0.6)])]
    report, _ = run(spark, d, plans)
    assert {key: r["target_tokens"] - r["tokens"] for key, r in report.items() if r["target_tokens"] != r["tokens"]} == {}


def test_a_large_rest_is_solved_exactly():
    assert M.knapsack({1_000: 10, 5_000_000: 1}, 4_900_000) == {1_000: 10}
    counts = {900_000: 1, **{4_000 + k: 1 for k in range(400)}}
    for rest in (400_001, 900_001, 1_234_567):
        got = M.knapsack(counts, rest)
        assert sum(k * n for k, n in got.items()) == rest and all(n <= counts[k] for k, n in got.items())


def test_documents_that_come_twice_count_once(spark):
    rows = [(k, "word " * 100, "s") for k in range(50)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report, selected = run(spark, d, [("p", "s", 1.0, 1, 1.0)])
    assert report["p", "s"]["target_tokens"] == report["p", "s"]["tokens"] == sum(r["n_tokens"] for r in selected) and len(selected) == 50


@pytest.mark.parametrize("slots", [4, 16])
def test_coarse_and_fine_slots_fill_alike(spark, slots, monkeypatch):
    monkeypatch.setattr(M, "SLOTS", slots)
    plans = [("a", "big one", 1.0, 2, 0.5), ("a", "MID-two", 1.0, 2, 0.5)]
    report, _ = run(spark, docs(spark), plans)
    assert all(r["tokens"] == r["target_tokens"] for r in report.values())


def test_a_rest_is_filled_from_documents_beyond_the_pool(spark):
    # all lengths but those of a few documents, which the pool may not hold, are the same
    rows = [(k, 10 if k % 1_499 else 7, "s") for k in range(6_000)]
    d = spark.createDataFrame([(k, "word " * n, s) for k, n, s in rows], "doc_id long, text string, source string")
    plans = [(f"p{k}", "s", 1.0, 1, 0.3 + k / 60_000) for k in range(12)]
    report, selected = run(spark, d, plans)
    sizes = M.token_count(M.F.col("text"))
    counts = {r["n"]: r["c"] for r in d.select(sizes.alias("n")).groupBy("n").agg(M.F.count("*").alias("c")).collect()}
    for r in report.values():
        best = M.knapsack(counts, r["target_tokens"])
        assert r["tokens"] == sum(k * n for k, n in best.items())
    assert len({(r["plan_name"], r["doc_id"]) for r in selected}) == len(selected)
