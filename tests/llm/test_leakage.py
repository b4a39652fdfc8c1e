import random

import pytest

from seqloom.llm import leakage as L
from seqloom.llm.textnorm import expand_macros, words

W = [f"word{k}" for k in range(400)]


@pytest.mark.parametrize(
    ("tex", "plain"),
    [
        (r"The \textbf{big} {\em red\/} fox", "the big red fox"),
        (r"W{\"o}ln \'{e}t\'e \c{c}a stra\ss e na\"{\i}ve", "woln ete ca strasse naive"),
        ("com-\nputer nickel-plated co\\-op", "computer nickelplated coop"),
        ("% hidden words\nmore % remark\nhere", "hidden words more here remark"),
        (r"\newcommand{\x}[1]{big #1 fox}\def\y{\x{red}}the \y\ ran", "the big red fox ran"),
        ("a~b~\\cite{key} c\\label{z}\r\nd", "a b c d"),
        (r"it took $572$ volts, \mbox{what}?", "it took 572 volts what"),
        ("Ràeth ﬁne", "raeth fine"),
    ],
)
def test_words_as_a_reader_sees_them(tex, plain):
    assert " ".join(words(tex)) == plain


def test_macros_that_are_broken_or_grow():
    assert expand_macros(r"\newcommand{\x}{open") == r"\newcommand{\x}{open"
    assert len(expand_macros(r"\def\x{\x\x}\x")) < 1_000_000


def brute(passage, text):
    """A stretch of 12 words or more of which at most a tenth is replaced or left out, by trying all alignments."""
    best = False
    n, m = len(passage), len(text)
    for s in range(n - 11):
        reach = {(j, 0) for j in range(m) if text[j] == passage[s]}
        for k in range(s, n):
            new = set()
            for j, e in reach:
                if j < m and text[j] == passage[k]:
                    new.add((j + 1, e))
                    if k - s + 1 >= max(12, 10 * e):
                        best = True
                if e < 4:
                    new |= {(j + 1, e + 1), (j, e + 1)}
            reach = new
    return best


def test_stretch_equals_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        p = rng.sample(W, 26)
        t = p[rng.randrange(8) : rng.randrange(14, 26)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t))
            if rng.random() < 0.5:
                t[k] = "other"
            elif len(t) > 1:
                del t[k]
        t = rng.sample(W, 5) + t + rng.sample(W, 5)
        assert (L.best_stretch(p, t) is not None) == brute(p, t), (p, t)


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, passage string, item_id int")
    i = spark.createDataFrame(items, "item_id long, passage string, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect())


def test_search_equals_brute_force(spark):
    rng = random.Random(2)
    passages = [" ".join(rng.sample(W, rng.randrange(12, 60))) for _ in range(12)]
    docs = []
    for k in range(60):
        p = passages[k % 12].split()
        a = rng.randrange(max(1, len(p) - 12))
        t = p[a : a + rng.randrange(8, 24)]
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "other"
        text = rng.choices(W, k=rng.randrange(0, 300)) + t + rng.choices(W, k=rng.randrange(0, 300))
        docs.append((k, " ".join(text).title(), "clash", 7))
    want = [(k, n) for k, d, _, _ in docs for n, p in enumerate(passages) if brute(p.split(), words(d))]
    assert found(spark, docs, [(n, p, "clash") for n, p in enumerate(passages)]) == want


def test_nulls_shared_passages_and_empty_tables(spark):
    p = " ".join(W[:20])
    docs = [(1, p, None, None), (2, None, None, None), (3, "", None, None), (4, "x " * 30_000 + p, None, None), (4, p, None, None)]
    items = [(7, p, None), (8, p, None), (9, None, None), (10, "too short", None)]
    assert found(spark, docs, items) == [(1, 7), (1, 8), (4, 7), (4, 7), (4, 8), (4, 8)]
    assert found(spark, [], items) == found(spark, docs, []) == []
    L_block, L.ITEM_BLOCK = L.ITEM_BLOCK, 1
    try:
        assert found(spark, docs[:1], [*items, (11, " ".join(W[5:40]), None)]) == [(1, 7), (1, 8), (1, 11)]
    finally:
        L.ITEM_BLOCK = L_block


def test_longest_of_several_stretches_is_reported(spark):
    rng = random.Random(12)
    passage = rng.sample(W[:200], 40)
    filler = lambda: [rng.choice(W[200:]) for _ in range(150)]
    flawed = [*passage[:20], "other", *passage[21:]]
    texts = {1: [*passage[:12], *filler(), *passage], 2: [*passage, *filler(), *passage[5:17]], 3: [*flawed, *filler(), *passage]}
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage))], "item_id long, passage string")
    got = sorted(tuple(r) for r in L.leaks(d, items).collect())
    assert got == [(1, 7, 40, 0), (2, 7, 40, 0), (3, 7, 40, 0)]


def test_fewest_errors_among_stretches_of_a_length():
    passage = W[:26]
    text = [*W[:6], "other", *W[7:12], *W[300:310], *W[14:26]]
    assert L.best_stretch(passage, text) == (12, 0)


def test_macros_are_written_out_however_deep_and_endless_ones_stay():
    from seqloom.llm.textnorm import expand_macros, words

    chain = "".join(f"\\newcommand{{\\m{chr(97 + k)}}}{{\\m{chr(98 + k)}{{}} w{k}}}" for k in range(9)) + "\\newcommand{\\mj}{end}"
    assert words(chain + " \\ma{} here") == ["end", *[f"w{k}" for k in range(8, -1, -1)], "here"]
    assert "\\aa" in expand_macros("\\def\\aa{\\bb}\\def\\bb{x \\aa}\\aa plain")
    double = "".join(f"\\def\\d{chr(97 + k)}{{\\d{chr(98 + k)}\\d{chr(98 + k)}}}" for k in range(24)) + "\\def\\dy{abc }"
    assert len(expand_macros(double + "\\da")) < 200_000_000


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    from seqloom.llm import leakage as K

    items = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(7)] + [(9, None), (10, "too short"), (11, " ".join(f"item3word{j}" for j in range(20)))]
    docs = [(k, f"before {items[k % 7][1]} after " * 2) for k in range(20)] + [(50, None), (51, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    want = sorted((k, k % 7) for k in range(20)) + [(k, 11) for k in range(20) if k % 7 == 3]
    for size in (1, 3, 2000):
        monkeypatch.setattr(K, "ITEM_BLOCK", size)
        assert sorted((r[0], r[1]) for r in K.leaks(d, i).collect()) == sorted(want)
