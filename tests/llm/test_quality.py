import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.llm import quality as Q

PROSE = "When the shear grows, the model of the field follows the data closely. It is not clear why this holds. " * 6
TEXTS = {
    "prose": r"\documentclass{article}\begin{document}" + "\n" + PROSE + "\n" + r"\end{document}",
    "table": "\\begin{tabular}{ll}\n" + "\n".join(f"Name{k} & {k}.5 & {k} \\\\" for k in range(40)) + "\n\\end{tabular}",
    "csv": "\n".join(f"Name{k},{k}.5,{k},7" for k in range(40)),
    "list": "\n".join(f"{k}. some item name" for k in range(40)),
    "bullets": "\n".join(f"$\\bullet$ item {k} of it" for k in range(40)),
    "junk": "\n".join("\\newpage\n\\clearpage\n\\hfill" for _ in range(30)),
    "noise": "█□□ ?? " * 200,
    "repeated": "click to enlarge " * 200,
    "empty": "",
    "null": None,
}
KIND = {"prose": "prose", "table": "table", "csv": "table", "list": "list", "bullets": "list", "junk": "junk", "noise": "junk", "repeated": "junk", "empty": "junk", "null": "junk"}


@pytest.mark.parametrize("name", TEXTS)
def test_labels(name):
    assert Q.label(TEXTS[name]) == KIND[name]


def test_statistics_have_defined_values(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS.values())] + [(99, "A" * 300_000, "", 1), (98, "word, " * 60_000 + ".", "", 1), (97, "%" * 5000 + "$" * 5001, "", 1)]
    words = ["when", "the", "of", "data", "it", "is", "not", "why", "this"]
    x = Q.statistics(spark.createDataFrame(rows, "doc_id long, text string, kind string, n_chars int"), words).toPandas().set_index("doc_id")
    assert not x.isna().any().any()
    at = {n: x.loc[k] for k, n in enumerate(TEXTS)}
    assert at["prose"]["sentence_share"] > 0.9 and at["prose"]["common_words"] > 0.3
    assert at["table"]["cell_share"] > 0.9 and at["csv"]["cell_share"] > 0.9
    assert at["list"]["entry_share"] > 0.9 and at["bullets"]["entry_share"] > 0.9
    assert at["junk"]["command_share"] > 0.9 and at["empty"]["n_words"] == 0
    assert x.loc[99]["n_chars"] == 300_000


def test_rules_find_a_planted_concept():
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.random((1500, len(Q.STATS))), columns=list(Q.STATS))
    y = np.where((x["cell_share"] > 0.7), "table", np.where((x["entry_share"] > 0.6) & (x["common_words"] < 0.5), "list", "prose"))
    rules = Q.induce(x[:1000], y[:1000])
    got = np.full(500, "prose", object)
    for r in reversed(rules):
        got[r.covers(x[1000:].reset_index(drop=True))] = r.kind
    assert (got == y[1000:]).mean() > 0.97


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = d.where("pmod(xxhash64(doc_id), 2) = 0")
    words = Q.common_words(some)
    rules = Q.learn(some, words)
    rest = d.where("pmod(xxhash64(doc_id), 2) = 1")
    got = Q.statistics(rest, words).select("doc_id", Q.case(rules).alias("kind")).toPandas().set_index("doc_id")["kind"].fillna("prose")
    want = rest.toPandas().set_index("doc_id")["text"].map(Q.label)
    assert (got.loc[want.index] == want).mean() > 0.98
    hard = want[want != "prose"]
    assert (got.loc[hard.index] == hard).mean() > 0.9


def test_empty_table(spark):
    assert Q.kinds(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = Q.common_words(d)
    assert words == Q.common_words(d.repartition(5, "text")) and len(words) == Q.COMMON_WORDS
    assert Q.learn(d, words) == Q.learn(d.repartition(5, "text"), words)


def test_wide_rows_and_long_sentences_count_whole(spark):
    wide = "\n".join("name" + f", {k}.5" * 90 for k in range(30))
    long = ("word " * 400 + "end. ") * 3
    rows = [(1, wide), (2, long), (3, "a,1,2\n" * 3 + "," * 200_000), (4, "word " * 100_000)]
    x = Q.statistics(spark.createDataFrame(rows, "doc_id long, text string"), ["word"]).toPandas().set_index("doc_id")
    assert x.loc[1]["cell_share"] > 0.99 and x.loc[2]["sentence_share"] > 0.99 and x.loc[2]["common_words"] > 0.9
    assert x.loc[3]["cell_share"] > 0.99 and x.loc[4]["sentence_share"] == 0


def test_common_words_are_those_of_most_documents(spark):
    d = spark.createDataFrame([(1, "alpha beta \\gamma beta"), (2, "Alpha delta"), (3, None), (4, "")], "doc_id long, text string")
    assert Q.common_words(d, n=2) == ["alpha", "beta"] and Q.common_words(d.limit(0)) == []


ODD = [
    "a,1,2\u2028b,3,4\n x", "....\u2028abc def ghi jkl\n", "$$a$b$$c$ \\$5 $x$ \\(y\\) \\[z\\]", "\\begin{align*}a\\\\b\\end{align}c\\begin{math}x\\end{mat}", "%x\n\\%y%z\r\nq\r%",
    "$\\bullet$ a\n\\(\\cdot\\) b\n$(\\star$\n$\\bullet\\) c", "1.5,2.5 3.x .4 {~}", "A\u0085B   C\u0085 \n\u3000\n \u2028\n", "x & y \\\\\n|a|b|\n1;2;3\n", "- a b c\n\\item foo\nab\\dotfill 3\n", "\\begin{comment}" + "\\a" * 100_000, "$$" * 2001, "", None,
]


def test_texts_that_lack_the_signs_are_not_searched_in_full(spark):
    d = spark.createDataFrame(list(enumerate([*ODD, *TEXTS.values()])), "k long, t string")
    for pattern, signs, other in ((Q._CELLS, Q._CELL_SIGNS, rf"(?m)^{Q._COMMAS}$"), (Q._ENTRY, Q._ENTRY_SIGNS, rf"(?m)^[ ]*(?:{Q._ITEM})\r?$"), (r"\r\n?", "\r", None)):
        rows = d.select(F.regexp_replace("t", pattern, "").alias("all"), Q._replaced("t", pattern, "", signs, other).alias("some")).collect()
        assert [r["some"] for r in rows] == [r["all"] for r in rows]
    rows = d.select(F.translate("t", " \n\t", "").alias("all"), Q._without("t", " \n\t").alias("some")).collect()
    assert [r["some"] for r in rows] == [r["all"] for r in rows]
    # where the full search takes time, it is left out
    prose = spark.range(4_000).select(F.lit(PROSE * 5).alias("t")).repartition(8).localCheckpoint()

    def seconds(column):
        began = time.perf_counter()
        prose.select(column).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    full, part = (min(seconds(c) for _ in range(3)) for c in (F.regexp_replace("t", Q._CELLS, ""), Q._replaced("t", Q._CELLS, "", Q._CELL_SIGNS, rf"(?m)^{Q._COMMAS}$")))
    assert part < 0.8 * full


@pytest.mark.parametrize("text", [t for t in ODD if t is not None])
def test_formulas_are_found_as_before_the_search_began_with_a_class(text):
    plain = r"\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)|(?<!\\)\$[^$]*\$"
    bullet = r"(?:\$|\\\()\s*\\(?:bullet|cdot|circ|star|ast|diamond|triangleright|rightarrow|blacksquare|square)\s*(?:\$|\\\))"
    env = rf"\\begin\{{({Q._ENVS})\*?\}}[\s\S]*?(?:\\end\{{\1\*?\}}|\Z)"
    assert re.sub(Q._MATH, "x", text) == re.sub(plain, "x", text) and re.sub(Q._BULLET, "•", text) == re.sub(bullet, "•", text) and re.sub(Q._ENV, "\n\n", text) == re.sub(env, "\n\n", text)
