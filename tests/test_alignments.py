import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from seqloom.operators import alignment as A
from seqloom.operators import distances as D
from seqloom.operators import frequencies as N
from seqloom.operators import potts as P
from seqloom.operators import sampling as M
from seqloom.operators import shuffles as S
from seqloom.plans import alignments as Q_

Q = A.Q


@pytest.fixture(scope="module")
def msa():
    rng = np.random.default_rng(5)
    base = rng.integers(0, Q, (3, 65))
    x = base[rng.integers(0, 3, 40)]
    x = np.where(rng.random(x.shape) < 0.3, rng.integers(0, 5, x.shape), x)
    x[0] = x[1] = 0
    x[2] = x[3]
    return {"A": x, "B": rng.integers(0, Q, (1, 7)), "C": rng.integers(0, 4, (9, 2))}


@pytest.fixture(scope="module")
def rows(spark, msa):
    data = [(f, 100 * k + n, s.tolist(), n * 1.0) for k, (f, x) in enumerate(msa.items()) for n, s in enumerate(x)]
    return spark.createDataFrame(data, "family string, seq_id long, states array<int>, w double").cache()


def dist(a, b):
    norm = ((a > 0) | (b > 0)).sum()
    return 1 - ((a == b) & (a > 0)).sum() / norm if norm else np.nan


def test_encode_decode_round_trip(spark, rows):
    x = rows.withColumn("t", A.decode(A.F.col("states"))).withColumn("back", A.encode(A.F.col("t")))
    assert x.where("back <> states").count() == 0
    odd = spark.createDataFrame([("ABxÉ-",)], "t string").select(A.encode(A.F.col("t")).alias("s"), A.encode(A.F.col("t"), 0).alias("z")).first()
    assert odd["s"] == [1, -1, -1, -1, 0] and odd["z"] == [1, 0, 0, 0, 0]


@pytest.mark.parametrize("block", [2, 7, 2048])
def test_distances_equal_numpy(msa, rows, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    got = {(r["family"], r["seq_id"]): r for r in D.weights(rows, 0.3).collect()}
    near = {r["seq_id"]: r["d"] for r in D.nearest(rows).collect()}
    hist = {(r["family"], r["bin"]): r["n"] for r in D.distance_histogram(rows).collect()}
    want_hist = {}
    for k, (f, x) in enumerate(msa.items()):
        d = np.array([[dist(a, b) for b in x] for a in x])
        for n in range(len(x)):
            same = np.arange(len(x)) == n
            with np.errstate(invalid="ignore"):
                assert got[f, 100 * k + n]["neighbours"] == ((d[n] < 0.3) | same).sum()
            other = d[n][~same]
            other = other[~np.isnan(other)]
            assert near.get(100 * k + n) == (pytest.approx(other.min()) if len(other) else None)
        for i, j in itertools.combinations(range(len(x)), 2):
            if not np.isnan(d[i, j]):
                key = f, min(19, int(np.floor(round(d[i, j] * 20, 9))))
                want_hist[key] = want_hist.get(key, 0) + 1
    assert hist == want_hist
    h = {r["seq_id"]: r["neighbours"] for r in D.weights(rows, 0.3, kind=D.HAMMING).collect()}
    for k, x in enumerate(msa.values()):
        for n in range(len(x)):
            assert h[100 * k + n] == ((x[n][None] != x).mean(axis=1) < 0.3).sum()


@pytest.fixture(scope="module")
def relatives():
    rng = np.random.default_rng(8)
    out = {}
    for width in (5, 64, 96, 140, 300):
        base = rng.integers(0, Q, (4, width))
        x = base[rng.integers(0, 4, 260)]
        x = np.where(rng.random(x.shape) < rng.choice([0.02, 0.15, 0.3, 0.6], (260, 1)), rng.integers(0, Q, x.shape), x)
        x[:12, width // 3 :] = 0
        out[width] = x.astype(np.uint8)
    return out


def test_near_pairs_equal_brute_force(relatives):
    for x in relatives.values():
        d = np.array([[dist(a, b) for b in x] for a in x])
        h = 1 - (x[:, None] == x[None]).sum(axis=2) / x.shape[1]
        for kind, far in ((D.GAP_AWARE, d), (D.HAMMING, h)):
            for theta in (0.1, 0.3, 0.8):
                got = {(int(r), int(c)) for i, j in D.near_pairs(x, None, theta, kind) for r, c in zip(i, j)}
                assert got == {(r, c) for r, c in zip(*np.nonzero(far < theta)) if r < c}
                got = {(int(r), int(c)) for i, j in D.near_pairs(x[:90], x[90:], theta, kind) for r, c in zip(i, j)}
                assert got == {(r, c) for r, c in zip(*np.nonzero(far[:90, 90:] < theta))}
    assert not list(D.near_pairs(x, None, -0.1, D.HAMMING))


@pytest.mark.parametrize("rows_a_task", [7, 100_000])
def test_block_strength_equals_numpy(msa, rows, rows_a_task):
    got = {(r["family"], r["i"], r["j"]): r["strength"] for r in N.block_strength(rows, rows_a_task=rows_a_task).collect()}
    for f, x in msa.items():
        hot = np.eye(Q)[x]
        for i, j in itertools.combinations(range(x.shape[1]), 2):
            c = hot[:, i].T @ hot[:, j] / len(x) - np.outer(hot[:, i].mean(0), hot[:, j].mean(0))
            assert got[f, i, j] == pytest.approx(np.sqrt((c * c).sum()), abs=1e-9)
    assert len(got) == sum(x.shape[1] * (x.shape[1] - 1) // 2 for x in msa.values())


def test_weighted_products_count_equal_weights_together():
    rng = np.random.default_rng(4)
    h = N._one_hot(rng.integers(0, Q, (300, 6)))
    for w in (np.where(rng.random(300) < 0.9, 1.0, rng.random(300)), rng.random(300), np.full(300, 0.25), np.zeros(300)):
        assert np.allclose(N._weighted(h, w), (h.astype(float) * w[:, None]).T @ h.astype(float), atol=1e-12)


def parts(rows):
    s = N.single_counts(rows)
    v = N.variable_columns(s, 4)
    t = rows.groupBy("family").agg(A.F.count("*").alias("total"))
    return v, s.join(v, ["family", "pos"], "left_semi"), N.column_tuples(rows, v, 2), t


def test_correlations(msa, rows):
    v, s, p, t = parts(rows)
    c = N.pair_correlations(p, s, t).collect()
    for r in c:
        x = msa[r["family"]]
        a, b = x[:, r["i"]] == r["a"], x[:, r["j"]] == r["b"]
        assert r["c"] == pytest.approx((a & b).mean() - a.mean() * b.mean(), abs=1e-12)
    for r in N.triple_correlations(N.column_tuples(rows, v, 3), p, s, t).collect():
        x = msa[r["family"]]
        a, b, d = x[:, r["i"]] == r["a"], x[:, r["j"]] == r["b"], x[:, r["k"]] == r["c"]
        m = lambda *z: np.logical_and.reduce(z).mean()
        want = m(a, b, d) - m(a, b) * m(d) - m(a, d) * m(b) - m(b, d) * m(a) + 2 * m(a) * m(b) * m(d)
        assert r["c3"] == pytest.approx(want, abs=1e-12)


def tables(spark, width=4):
    h = [("A", i, a, ((7 * i + 3 * a) % 11 - 5) / 10) for i in range(width) for a in range(Q)]
    j = [("A", i, k, a, b, ((5 * i + 3 * k + 2 * a + 7 * b) % 13 - 6) / 20) for i in range(width) for k in range(i + 1, width) for a in range(Q) for b in range(Q)]
    return spark.createDataFrame(h, "family string, pos int, state int, v double"), spark.createDataFrame(j, "family string, i int, j int, a int, b int, v double")


def test_pack_and_unpack(spark):
    h, j = tables(spark)
    w = spark.createDataFrame([("A", 4)], "family string, width int")
    packed = P.pack(h, j, w)
    assert sorted(r["offset"] for r in packed.collect()) == list(range(6 * Q * Q + 4 * Q))
    h2, j2 = P.unpack(packed, w)
    assert h2.exceptAll(h).count() == h.exceptAll(h2).count() == 0
    assert j2.exceptAll(j).count() == j.exceptAll(j2).count() == 0


def test_gauge_keeps_energies_and_has_zero_sums(spark):
    h, j = tables(spark)
    h2, j2 = P.zero_sum_gauge(h, j)
    assert max(abs(r["s"]) for r in h2.groupBy("family", "pos").agg(A.F.sum("v").alias("s")).collect()) < 1e-9
    for by in (["i", "j", "a"], ["i", "j", "b"]):
        assert max(abs(r["s"]) for r in j2.groupBy(*by).agg(A.F.sum("v").alias("s")).collect()) < 1e-9
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("A", n, rng.integers(0, Q, 4).tolist()) for n in range(12)], "family string, seq_id long, states array<int>")
    one = {r["seq_id"]: r["energy"] for r in P.energies(rows, h, j).collect()}
    two = {r["seq_id"]: r["energy"] for r in P.energies(rows, h2, j2).collect()}
    shift = [one[k] - two[k] for k in one]
    assert max(shift) - min(shift) < 1e-9


def test_mask_keeps_the_largest_and_their_mirrors(spark):
    _, j = tables(spark)
    kept = {(r["i"], r["j"], r["a"], r["b"]) for r in P.kept_couplings(j, 98, 4).collect()}
    k = int(16 * 441 / 2 * 0.02)
    if_sorted = sorted(j.collect(), key=lambda r: (-round(abs(r["v"]), 9), r["i"], r["j"], r["a"], r["b"]))[:k]
    up = {(r["i"], r["j"], r["a"], r["b"]) for r in if_sorted}
    assert kept == up | {(y, x, b, a) for x, y, a, b in up}


def test_draws_keep_marginals_and_do_not_depend_on_partitions(rows):
    x = A.shuffle_columns(rows)
    n = x.groupBy("family", "pos", "state").count()
    assert n.exceptAll(N.single_counts(rows).withColumnRenamed("n", "count")).count() == 0
    one, two = A.in_train(rows), A.in_train(rows.repartition(5, "w"))
    assert one.where("is_train").select("seq_id").exceptAll(two.where("is_train").select("seq_id")).count() == 0
    assert one.where("family = 'A' and is_train").count() == 32


def test_profile_samples_follow_the_fields(spark):
    h = spark.createDataFrame([("A", i, a, float(a == i) * 2.0) for i in range(3) for a in range(Q)], "family string, pos int, state int, v double")
    n = spark.createDataFrame([("A", 3000)], "family string, n long")
    x = np.stack([np.array(r["states"]) for r in M.sample(h, None, n, 400).orderBy("chain").collect()])
    want = np.exp(2) / (np.exp(2) + Q - 1)
    assert len(x) == 3000
    for i in range(3):
        assert abs((x[:, i] == i).mean() - want) < 0.03
    again = M.sample(h.repartition(3), None, n, 400).where("chain = 2999").first()["states"]
    assert again == x[2999].tolist()


def test_pairwise_sampler_equals_enumeration():
    rng = np.random.default_rng(2)
    h = rng.normal(0, 0.5, (2, 3))
    j = np.zeros((2, 2, 3, 3))
    j[0, 1] = rng.normal(0, 1, (3, 3))
    j[1, 0] = j[0, 1].T
    p = np.exp(h[0][:, None] + h[1][None] + j[0, 1])
    p /= p.sum()
    x = M.metropolis(h, j, 20_000, 60, M.generator(1, "A", 0))
    got = np.zeros((3, 3))
    np.add.at(got, (x[:, 0], x[:, 1]), 1 / len(x))
    assert np.abs(got - p).max() < 0.015


def test_fit_lowers_the_gradient(rows):
    _, s, p, t = parts(rows.where("family = 'A'"))
    h = M.fit(s, p, t, iterations=8, chains=400, steps=200).orderBy("iteration").collect()
    assert h[-1]["gradient_norm"] < h[0]["gradient_norm"] and h[-1]["pearson"] > h[0]["pearson"]


def test_components_are_those_of_the_covariance(msa, rows):
    v, s, p, t = parts(rows.where("family = 'A'"))
    load = M.components(s, p, t).collect()
    x = msa["A"]
    keys = sorted({(r["pos"], r["state"]) for r in load})
    hot = np.stack([x[:, c] == a for c, a in keys], axis=1).astype(float)
    values, vectors = np.linalg.eigh(np.cov(hot, rowvar=False))
    got = np.array([next(r["loading"] for r in load if r["component"] == 0 and (r["pos"], r["state"]) == k) for k in keys])
    assert abs(abs(got @ vectors[:, -1]) - 1) < 1e-6 and got[np.abs(got).argmax()] > 0
    score = {r["seq_id"]: r["score"] for r in M.project(N.at_columns(rows.where("family = 'A'"), v), M.components(s, p, t)).where("component = 0").collect()}
    for n in range(len(x)):
        assert score.get(n, 0.0) == pytest.approx(hot[n] @ got, abs=1e-9)
    assert values[-1] > 0


def test_empty_alignment(rows):
    none = rows.limit(0)
    assert D.weights(none, 0.3).count() == N.block_strength(none).count() == N.single_counts(none).count() == 0


def small_groups():
    rng = np.random.default_rng(12)
    out = {}
    for g, (n, width) in {"A": (40, 6), "B": (7, 5), "C": (1, 4)}.items():
        x = rng.integers(0, 5, (n, width))
        x[:, 1] = x[:, 0]
        out[g] = x
    return out


def pair_counts(x, w=None):
    n, width = x.shape
    hot = np.eye(21)[x]
    return np.einsum("n,nia,njb->ijab", np.ones(n) if w is None else w, hot, hot)


@pytest.mark.parametrize("task", [100_000, 3])
def test_pair_statistics_equal_numpy(spark, task, monkeypatch):
    monkeypatch.setattr(N, "ROWS_A_TASK", task)
    groups = small_groups()
    rng = np.random.default_rng(13)
    data, weights = [], {g: rng.random(len(x)) for g, x in groups.items()}
    for g, x in groups.items():
        data += [(g, len(data) + k, s.tolist(), float(weights[g][k]), "clash") for k, s in enumerate(x)]
    df = spark.createDataFrame(data, "family string, seq_id long, states array<int>, w double, i string")
    got = {(r["family"], r["i"], r["j"]): r["strength"] for r in N.block_strength(df, weight="w").collect()}
    energies = {r["seq_id"]: r["energy"] for r in P.pair_energies(df, N.log_odds, P.profile_fields(N.with_pseudocount(N.single_counts(df), df.groupBy("family").agg(F.count("*").alias("total")), df.groupBy("family").agg(F.max(F.size("states")).alias("n_cols")))), rows_a_task=5).collect()}
    kept = {}
    for r in N.kept_cells(df, N.correlation, 90).collect():
        kept.setdefault(r["family"], set()).add((r["i"], r["j"], r["a"], r["b"]))
    first = 0
    for g, x in groups.items():
        n, width = x.shape
        c = pair_counts(x, weights[g])
        p = c / weights[g].sum()
        f = np.array([np.diag(p[i, i]) for i in range(width)])
        for i in range(width):
            for j in range(i + 1, width):
                assert got[g, i, j] == pytest.approx(np.linalg.norm(p[i, j] - np.outer(f[i], f[j])), abs=1e-9)
        q = (1 - 1 / n) * pair_counts(x) / n + 1 / n / 441
        h = np.log((1 - 1 / n) * np.array([np.diag(pair_counts(x)[i, i]) for i in range(width)]) / n + 1 / n / 21)
        for k, s in enumerate(x):
            e = -h[np.arange(width), s].sum() - sum(np.log(q[i, j, s[i], s[j]]) - h[i, s[i]] - h[j, s[j]] for i in range(width) for j in range(i + 1, width))
            assert energies[first + k] == pytest.approx(e, abs=1e-8)
        first += n
        p = pair_counts(x) / n
        f = np.array([np.diag(p[i, i]) for i in range(width)])
        cells = [(-round(abs(p[i, j, a, b] - f[i, a] * f[j, b]), 9), i, j, a, b) for i in range(width) for j in range(i + 1, width) for a in range(21) for b in range(21)]
        want = [z[1:] for z in sorted(cells)[: int(width * width * 441 / 2 * 0.1 + 1e-9)] if z[0] < 0]
        assert kept.get(g, set()) == set(want)
    assert N.kept_cells(df, N.correlation, 100).count() == 0 and N.kept_cells(df.limit(0), N.correlation, 90).count() == 0


def test_ranks_over_several_windows(spark):
    rng = np.random.default_rng(14)
    data = [(str(k % 3), k, int(rng.integers(0, 20))) for k in range(200)] + [("0", 999, None)]
    df = spark.createDataFrame(data, "family string, seq_id long, o long")
    for size in (1, 7, 1000):
        got = {r["seq_id"]: (r["_r"], r["_n"]) for r in A.ranked(df, ["family"], F.col("o"), "seq_id", size).collect()}
        for g in "012":
            order = sorted((o, k) for f, k, o in data if f == g and o is not None)
            assert {k: (r + 1, len(order)) for r, (_, k) in enumerate(order)} == {k: v for k, v in got.items() if str(k % 3) == g}


def test_draws_by_column_equal_md5():
    import hashlib

    keys = [0, 7, -3, 12345, 10**18, -(2**63), 2**63 - 1, 99, 100]
    draws = S.Draws("shuffle", np.array(keys))
    for pos in (0, 9, 10, 123, 4567):
        assert draws(pos).tolist() == [int(hashlib.md5(f"shuffle:{pos}:{k}".encode()).hexdigest()[:8], 16) for k in keys]


@pytest.mark.parametrize("columns, packed", [(32, 1 << 16), (3, 4)])
def test_shuffled_checksums_equal_the_sums_of_shuffled_cells(spark, columns, packed, monkeypatch):
    monkeypatch.setattr(S, "COLUMNS", columns)
    monkeypatch.setattr(S, "ROWS", packed)
    rng = np.random.default_rng(3)
    # rows of unlike width, nulls, a row of nulls, one without columns, states beyond a byte, no group
    data = [("A", int(n) - 20, [None if rng.random() < 0.1 else int(s) for s in rng.integers(-1, Q, rng.integers(1, 40))]) for n in rng.permutation(60)]
    data += [("B", 5, [None, None]), ("B", 6, []), ("B", 7, None), ("C", 1, [1 << 20, -(1 << 31)]), ("C", 2, [3, 300]), ("C", 3, [-128, 4]), ("D", -(1 << 62), [2]), ("D", 1 << 62, [9]), (None, 8, [1])]
    rows = spark.createDataFrame(data, "family string, seq_id long, states array<int>").repartition(3)
    want = A.shuffle_columns(rows).groupBy("family", "seq_id").agg(F.sum((F.col("pos") + 1) * F.col("state").cast("long")).alias("checksum"))
    got = sorted(map(tuple, S.shuffled_checksums(rows).collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and ("B", 5, None) in got


def test_shuffled_columns_query_makes_no_row_for_each_cell(spark):
    plan = Q_.QUERIES["r3_shuffled_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_rows_as_bytes_are_the_rows(spark, tmp_path):
    from datetime import datetime

    states = [[1, 2], [1, 300], None, [], [None, -129], [None], [127, -128], [1 << 30]]
    data = [(k, "A", "Train", s, datetime(2026, 1, 1 + day)) for k, s in enumerate(states) for day in (0, k % 2)] + [(0, "A", "Test", [5, 6], datetime(2026, 2, 1)), (None, "A", None, [1], None)]
    spark.createDataFrame(data, "seq_id long, family string, split string, states array<int>, loaded_at timestamp").write.parquet(f"{tmp_path}/align_rows.parquet")
    want, got = Q_.rows(spark, str(tmp_path)), Q_.rows_as_bytes(spark, str(tmp_path))
    assert got.schema == want.schema and want.count() == 7
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pairs_of_blocks_are_spread_over_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 10)
    reps = D.distinct_rows(rows, "family", "seq_id", "states")[0]
    none = lambda one, two: {"_k": one[0][:0], "value": one[0][:0]}
    # families of 38, 1 and 9 distinct rows have 4, 1 and 1 blocks, so 12 pairs of blocks
    assert reps.groupBy("family").count().count() == 3
    assert D.compare(reps, None, none, "family", "_k long, value long").rdd.getNumPartitions() == 24
    assert D._partitions(reps, reps, "family") == 2 * (16 + 1 + 1)


def test_first_columns_are_not_asked_where_they_leave_too_much(monkeypatch):
    rng = np.random.default_rng(4)
    # all rows are about as near to each other, so that the first columns rule hardly any pair out
    x = np.where(rng.random((600, 96)) < 0.4, rng.integers(0, Q, (600, 96)), rng.integers(1, Q, 96)[None]).astype(np.uint8)
    calls, call = [], D._Counter.__call__
    monkeypatch.setattr(D._Counter, "__call__", lambda self, i, j, both=False: calls.append(both) or call(self, i, j, both))
    least = np.full(len(x), np.inf)
    D._nearest(x, None, least, least)
    tiles = sum(1 for _ in D._tiles(len(x), len(x), True))
    assert len(calls) - sum(calls) < 1.5 * tiles
    norm, same = ((x[:, None] > 0) | (x[None] > 0)).sum(axis=2), ((x[:, None] == x[None]) & (x[:, None] > 0)).sum(axis=2)
    d = 1 - same / norm
    np.fill_diagonal(d, np.inf)
    assert np.allclose(least, d.min(axis=1))


@pytest.mark.parametrize("name", ["j1_diversity_histogram", "j3_nearest_other"])
def test_distance_queries_send_states_as_bytes(spark, name, monkeypatch):
    sent = []
    as_bytes = Q_.rows_as_bytes
    monkeypatch.setattr(Q_, "rows_as_bytes", lambda *a: sent.append(name) or as_bytes(*a))
    assert Q_.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and sent == [name]
