import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import edits as E
from seqloom.llm import neardup as N

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def near(a, b):
    """By trying every exchange of two neighbouring blocks."""
    most = max(len(a), len(b)) // 10
    if edit_distance(a, b) <= most:
        return True
    n = len(a)
    for x in range(n):
        for y in range(x + 1, n):
            for z in range(y + 1, n + 1):
                moved = a[:x] + a[y:z] + a[x:y] + a[z:]
                if sum(p != q for p, q in zip(moved, b, strict=False)) + abs(len(moved) - len(b)) <= most or (most and abs(len(a) - len(b)) <= most and edit_distance(moved, b) <= most):
                    return True
    return False


def edited(rng, s, edits, move):
    s = list(s)
    for _ in range(edits):
        k, p = rng.integers(0, 3), int(rng.integers(0, len(s)))
        if k == 0:
            s[p] = LETTERS[rng.integers(0, 20)]
        elif k == 1 and len(s) > 1:
            del s[p]
        else:
            s.insert(p, LETTERS[rng.integers(0, 20)])
    if move:
        a, b, c = sorted(rng.choice(len(s) + 1, 3, replace=False))
        s = s[:a] + s[b:c] + s[a:b] + s[c:]
    return "".join(s)


def text(rng, n):
    return "".join(LETTERS[k] for k in rng.integers(0, 20, n))


@given(st.lists(st.tuples(st.text("ACD", max_size=12), st.text("ACD", max_size=12)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_banded_distance(pairs):
    both, size = E.encode([x for p in pairs for x in p])
    a, b = both[::2], both[1::2]
    la, lb = size[::2], size[1::2]
    got = E.banded(a, la, b, lb, np.full(len(pairs), 4))
    for g, (x, y) in zip(got, pairs, strict=True):
        d = edit_distance(x, y)
        assert g == d if d <= 4 else g > 4


def test_planted_pairs_are_verified_and_others_not():
    rng = np.random.default_rng(3)
    a = [text(rng, int(rng.integers(50, 140))) for _ in range(300)]
    b = [edited(rng, s, int(rng.integers(0, len(s) // 10 + 1)), k % 2) for k, s in enumerate(a)]
    assert E.verify(pd.Series(a), pd.Series(b)).all()
    assert not E.verify(pd.Series(a), pd.Series(b[1:] + b[:1])).any()


def test_small_cases_equal_brute_force():
    rng = np.random.default_rng(4)
    pairs = []
    for k in range(60):
        s = text(rng, 20)
        pairs.append((s, edited(rng, s, int(rng.integers(0, 4)), k % 3 > 0)))
    got = E.verify(pd.Series([p for p, _ in pairs]), pd.Series([q for _, q in pairs]))
    want = np.array([near(p, q) for p, q in pairs])
    assert (got == want).all()


@pytest.mark.parametrize("size", [12, 26, 33, 58])
def test_stretches_are_the_cheapest(size):
    rng = np.random.default_rng(5)
    x, _ = E.encode([text(rng, size) for _ in range(8)])
    table = rng.integers(1, 50, N.SLOTS).astype(np.float32)
    start, length = N.allocate(x, size, table)
    need, k = int(N.needed(size)), int(N.stretch_length(size))
    assert start.shape == (8, need) and (start[:, 1:] >= (start + length)[:, :-1]).all() and ((start + length)[:, -1] <= size).all()
    six = table[N._slot(N._grams(x, N.K))]

    def cost(r, at, n):
        return min(six[r, min(p, six.shape[1] - 1)] for p in range(at, max(at, at + n - N.K) + 1))

    for r in range(8):
        # by trying every way to place the stretches
        best = {0: 0.0}
        for _ in range(need):
            new = {}
            for at, c in best.items():
                for skip in range(at, size):
                    for n in (k, k + 1):
                        if skip + n <= size:
                            end = skip + n
                            new[end] = min(new.get(end, 1e9), c + cost(r, skip, n))
            best = new
        assert sum(cost(r, int(a), int(n)) for a, n in zip(start[r], length[r], strict=True)) == pytest.approx(min(best.values()))


def test_stretches_suffice_at_every_length():
    rng = np.random.default_rng(10)
    for size in (1, 2, 3, 4, 9, 10, 36, 91, 140, 3_000):
        x, sizes = E.encode([text(rng, size) for _ in range(5)])
        table = np.ones(N.SLOTS, np.float32)
        row, pos, length, key = N._own(x, sizes, pa.array(N.probes(x, sizes, table)))
        assert (np.bincount(row) == (size // 10 + 4 if size > 3 else size)).all()
        assert all(pos[i + 1] >= pos[i] + length[i] for i in range(len(row) - 1) if row[i] == row[i + 1])
        # the other text is looked for at every length of stretch that a longer one may probe
        for other in range(size, size + size // 9 + 1):
            k = int(N.stretch_length(other))
            for n in (k, k + 1) if other > k * N.needed(other) else (k,):
                assert N._lengths(size) >> n & 1


def test_counts_of_letters_bound_the_edits():
    rng = np.random.default_rng(11)
    a = [text(rng, 90) for _ in range(60)]
    x, size = E.encode(a)
    c = N._spread(N.composition(x, size))
    n = np.array([[t.count(z) for z in LETTERS] for t in a])
    i, j = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    d = (n[i] - n[j]) % 8
    assert (N.apart(c[:, i], c[:, j]) == np.minimum(d, 8 - d).sum(axis=1)).all()


@given(st.text("ACD", max_size=9), st.text("ACD", max_size=9), st.integers(0, 2))
@settings(max_examples=150, deadline=None)
def test_exact_move_equals_brute_force(a, b, most):
    want = any(
        edit_distance(a[:x] + a[y:z] + a[x:y] + a[z:], b) <= most
        for x in range(len(a)) for y in range(x + 1, len(a)) for z in range(y + 1, len(a) + 1)
    )
    assert E.exact_move(a, b, most) == want
    if want:
        assert E.lacking(a, b, 99) <= most + 3 and E.lacking(b, a, 99) <= most + 3


def test_long_texts_are_searched_exactly_too(monkeypatch):
    # the search by diagonals finds nothing here, so the exact one has to
    monkeypatch.setattr(E, "_moves", lambda a, la, *_: np.zeros(len(la), bool))
    rng = np.random.default_rng(11)
    for n in (120, 290):
        s = text(rng, n)
        other = s[: n // 3] + s[2 * n // 3 :] + s[n // 3 : 2 * n // 3]
        near = other[:20] + "".join(LETTERS[k] for k in rng.integers(0, 20, 4)) + other[24:-9] + other[-8:]
        assert E.verify(pd.Series([s, near, s]), pd.Series([near, s, text(rng, n)])).tolist() == [True, True, False]


SCHEMA = "seq_id long, states array<int>, loaded_at timestamp, s string, class string"


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r[0], r[1]) for r in N.all_pairs(N.near_duplicates(df)).collect())


def states(s):
    return [LETTERS.index(c) + 1 if c != "-" else 0 for c in s]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_all_pairs_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "FREQUENT", 2)
    monkeypatch.setattr(N, "PART", 2)
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(12):
        s = text(rng, 80)
        texts += [s, s, edited(rng, s, 4, False), edited(rng, s, 3, True)]
    texts += [text(rng, 80) for _ in range(20)] + ["ACD", "ACD", "CAD", "AC-D".replace("-", "")]
    rows = [(k, states(t), None, "x", "y") for k, t in enumerate(texts)]
    got = pairs_of(spark, rows)
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] == texts[j] or E.verify(pd.Series([texts[i]]), pd.Series([texts[j]]))[0]]
    assert got == want


def replaced_and_moved(rng, s):
    """As many replacements as the bound allows, and a move."""
    s = list(s)
    for p in rng.choice(len(s), len(s) // 10, replace=False):
        s[p] = LETTERS[(LETTERS.index(s[p]) + int(rng.integers(1, 20))) % 20]
    a, b, c = sorted(rng.choice(len(s) + 1, 3, replace=False))
    return "".join(s[:a] + s[b:c] + s[a:b] + s[c:])


def test_no_planted_pair_is_lost_before_verification(spark, monkeypatch):
    # what is planted is a case by its making: every pair counts as one, so that only candidates are judged
    monkeypatch.setattr(N, "verify", lambda a, b: np.ones(len(a), bool))
    rng = np.random.default_rng(9)
    lengths = [n for n in (12, 20, 30, 36, 40, 50, 60, 70, 91, 110, 140) for _ in range(60)]
    first = [text(rng, n) for n in lengths]
    rows = [(k, states(t), None, None, None) for k, t in enumerate(first + [replaced_and_moved(rng, s) for s in first])]
    got = set(pairs_of(spark, rows))
    lost = [lengths[k] for k in range(len(first)) if (k, k + len(first)) not in got and first[k] != "".join(LETTERS[x - 1] for x in rows[k + len(first)][1])]
    assert not lost


def test_nulls_gaps_redeliveries_and_empty_tables(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rng = np.random.default_rng(7)
    s, other = text(rng, 60), text(rng, 60)
    rows = [
        (1, states(s), t[0], None, None),
        (1, states(s), t[0], None, None),
        (2, states(other), t[0], None, None),
        (2, states(s), t[2], None, None),
        (3, None, t[0], None, None),
        (4, [0, 0, 0], t[0], None, None),
        (5, [], None, None, None),
        (None, states(s), t[1], None, None),
        (6, [None, *states("-" + s)], t[1], None, None),
    ]
    assert pairs_of(spark, rows) == [(1, 2), (1, 6), (2, 6)]
    assert pairs_of(spark, []) == []
    # the last delivery counts, even where it is null
    assert pairs_of(spark, [(1, states(s), t[0], None, None), (1, None, t[1], None, None), (2, states(s), t[0], None, None)]) == []


def test_long_texts(spark):
    rng = np.random.default_rng(8)
    s = text(rng, 30_000)
    t = s[:100] + "A" + s[101:]
    rows = [(1, states(s), None, None, None), (2, states(t), None, None, None), (3, states(s), None, None, None)] + [(10 + k, states(text(rng, 30)), None, None, None) for k in range(5)]
    assert pairs_of(spark, rows) == [(1, 2), (1, 3), (2, 3)]


def test_exact_move_takes_many_beginnings_at_a_time(monkeypatch):
    import sys

    a = "VNPNFASFIYHDMADDISPMMCELRRFMRNWMFAVNGKMMYFNIPSENGCDVHQKWGDCNIQELEDQ"
    b = "VNPNKFASFIYHDMADDISFPMMCELRRFGMRNWMFAVNGKMMYFNIPSGDCNIQEENGCDVHQKWLEDQ"
    steps = []
    sys.setprofile(lambda frame, event, _: event == "call" and frame.f_code.co_name == "step" and steps.append(1))
    try:
        assert E.exact_move(a, b, 7)
    finally:
        sys.setprofile(None)
    # one beginning at a time takes 2,810
    assert len(steps) < 500
    # and with any number at a time the answer is the same
    for cells in (1, 5_000, 20_000):
        monkeypatch.setattr(E, "CELLS", cells)
        assert E.exact_move(a, b, 3) and not E.exact_move(a[::-1], b, 7)


def test_blobs_of_postings_come_back_whole_and_small():
    rng = np.random.default_rng(2)
    x, size = E.encode([text(rng, n) for n in rng.integers(60, 120, 20_000)])
    ids, comp = np.sort(rng.choice(10**7, len(size), replace=False)), N.composition(x, size)
    row = rng.permutation(len(size)).astype(np.uint64)
    p = np.sort(rng.integers(0, 1 << 32, len(row)).astype(np.uint64) << np.uint64(22) | row << np.uint64(2) | np.uint64(1))
    blob = N._blob(p, ids, comp, size)
    g, local, i, c, n = N._unblob(blob)
    assert (i == ids).all() and (c == comp).all() and (n == size).all()
    assert (g == (p >> np.uint64(22)).astype(np.uint32)).all() and (local >> 2 == (p >> np.uint64(2) & np.uint64((1 << 20) - 1)).astype(np.uint32)).all() and (local & 3 == 1).all()
    # with eight bytes a row for the letters' counts it has 306,097
    assert len(blob) < 298_000


def test_stored_texts_hold_no_hashes(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], 1.0)], "seq_id long, states array<int>, loaded_at double")
    t = N.text_table(df, "seq_id", "states", "loaded_at", spark.sparkContext.broadcast(np.ones(N.SLOTS, np.float32)))
    assert spark.read.parquet(*t.inputFiles()).columns == ["seq_id", "loaded", "s", "pr"] and {"h", "h2"} <= set(t.columns)


def test_open_pairs_are_searched_one_way_round_first(monkeypatch):
    rng = np.random.default_rng(41)
    a = [text(rng, 60) for _ in range(30)]
    # seven replacements in a block: more than 60 // 10
    b = [s[:20] + "".join("A" if c != "A" else "C" for c in s[20:27]) + s[27:] for s in a]
    searched = []
    moves = E._moves
    monkeypatch.setattr(E, "_moves", lambda *args: searched.append((len(args[1]), args[-2])) or moves(*args))
    E.verify(pd.Series(a), pd.Series(b))
    far = sum(edit_distance(x, y) > 6 for x, y in zip(a, b, strict=True))
    assert far > 20 and sum(n for n, diagonals in searched if diagonals == 1) == far


def test_place_of_a_key_from_its_kmer():
    rng = np.random.default_rng(43)
    for k in (1, 6, 9, 12):
        gram = rng.integers(0, 1 << 5 * k, (7, 30))
        assert (N._bit(gram, N.PROBED, 0, k) == N._bit(N._key(gram, k), N.PROBED, 0)).all()
    bit = N._bit(rng.integers(0, 1 << 62, 100_000), N.TWICE, 1)
    assert bit.min() >= 0 and bit.max() < N.TWICE and len(np.unique(bit)) > 99_900


@pytest.mark.parametrize(("n", "m"), [(300, 280), (280, 300), (60, 60)])
def test_moves_in_texts_of_unlike_widths(n, m):
    rng = np.random.default_rng(47)
    s = text(rng, max(n, m))
    t = s[: n // 5] + s[n // 2 : n // 2 + n // 5] + s[n // 5 : n // 2] + s[n // 2 + n // 5 :]
    (a, la), (b, lb) = E.encode([s[:n]]), E.encode([t[:m]])
    assert E._moves(a, la, b, lb, E.budget(np.maximum(la, lb)), 1, 2).all()
