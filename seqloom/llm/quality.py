"""Text quality: statistics of each document and learned rules that tell prose from lists, tables and junk.

The statistics are Spark expressions. A bounded sample of documents is
labelled by ``label`` (a slow reader that weighs a text line by line), an
ordered rule list is induced from the sample by incremental reduced-error
pruning, and the rules' thresholds become one CASE expression over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the rules are learned from (expected number; chosen by the id's hash).
SAMPLE = 6_000

# --- statistics ---------------------------------------------------------------------------------------------------

#: How many words count as common: those that most documents of the corpus have.
COMMON_WORDS = 120

_ENVS = "equation|align|alignat|eqnarray|gather|multline|displaymath|math|thebibliography|comment"
_PREAMBLE = (
    "documentclass|usepackage|title|author|date|maketitle|thanks|input|include|newcommand|renewcommand|providecommand|def|DeclareMathOperator|"
    "bibliography|bibliographystyle|label|section|subsection|subsubsection|chapter|paragraph|appendix|tableofcontents|begin|end|centering|toprule|midrule|bottomrule|hline"
)
#: An environment up to its end; what a repeat took it never gives back.
_ENV = rf"\\begin\{{({_ENVS})\*?\}}(?:[^\\]++|\\(?!end\{{\1\*?\}}))*+(?:\\end\{{\1\*?\}})?+"
# formulas and bullets begin with a class of signs, which a search skips to; what the sign was is asked behind it
_MATH = r"[$\\](?:(?<=\$)\$[\s\S]*?\$\$|(?<=\\)\[[\s\S]*?\\\]|(?<=\\)\([\s\S]*?\\\)|(?<=\$)(?<!\\\$)[^$]*+\$)"
#: Signs that stand at the head of an entry, set as formulas.
_BULLET = r"[$\\](?:(?<=\$)|(?<=\\)\()\s*+\\(?:bullet|cdot|circ|star|ast|diamond|triangleright|rightarrow|blacksquare|square)\s*+(?:\$|\\\))"
#: A line of cells; what a repeat took it never gives back, which keeps the time linear in the line.
_COMMAS = r"[^\n,]*+(?:,[-+\d. ]*+){2,}+\r?"
_CELLS = rf"(?m)^(?:[^\n&]*&[^\n]*\\\\[^\n]*|[^\n\t]*\t[^\n]*|[^\n|]*\|[^\n|]*\|[^\n]*|{_COMMAS}|[^\n;]*+(?:;[-+\d. ]*+){{2,}}+\r?|[^\n]*?\S {{3,}}\S[^\n]*)$"
#: Without these a line of cells can only be one of commas.
_CELL_SIGNS = ("&", "\t", "|", ";", "   ")
_ITEM = r"(?:[-–—]{1,3}|[*+•·]|\(?\d{1,4}[ ]?[.):\-]|\(?[a-zA-Z][.)])[ ](?:\S++[ ]++){0,8}\S*+[ ]*|\\(?:item|entry|glsentry)[^\n]{0,90}"
_ENTRY = rf"(?m)^[ ]*(?:{_ITEM}|[^\n]*(?:\\dotfill|\.{{4,}}|\\\\)[^\n]{{0,12}})\r?$"
#: Without these an entry can only be one with a mark at its head.
_ENTRY_SIGNS = (r"\dotfill", "....", r"\\")
#: What no sentence holds; a sentence begins behind it, so that each run of other signs is looked through once. Decimals are taken out before, so that a point ends a sentence.
_STOP = r".!?\\&|=<>_^*#+@"
_SENTENCE = rf"(?:^|(?<=[{_STOP}]))[^{_STOP}]{{25,}}+[.!?]"
_DECIMAL = r"[.,](?<=\d[.,])(?=\d)"
_COMMAND = r"\\[A-Za-z@]+\*?(?:\[[^\]\n]*\])?"

STATS = (
    "n_chars",
    "n_words",
    "n_lines",
    "mean_word_length",
    "symbol_ratio",
    "digit_ratio",
    "punctuated_lines",
    "common_words",
    "sentence_share",
    "cell_share",
    "entry_share",
    "command_share",
    "distinct_words",
    "single_letters",
    "mean_line_length",
)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _has(c: str, signs: Sequence[str]) -> Column:
    return reduce(or_, (F.contains(F.col(c), F.lit(s)) for s in signs))


def _replaced(c: str, pattern: str, to: str, signs: Sequence[str], other: str | None = None) -> Column:
    """``c`` with what the pattern finds replaced. A text without any of the signs is searched for ``other`` only, which is all that the pattern can find there (None: nothing)."""
    rest = F.col(c) if other is None else F.regexp_replace(c, other, to)
    return F.when(_has(c, signs), F.regexp_replace(c, pattern, to)).otherwise(rest)


def _without(c: Column | str, signs: str) -> Column:
    """``c`` without these signs; on bytes, as ``translate`` looks every letter up."""
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), signs, F.col(c) if isinstance(c, str) else c)


def common_words(documents: DataFrame, text: str = "text", n: int = COMMON_WORDS) -> list[str]:
    """The ``n`` words that most documents have, commands left out; counted over all documents, ties by the word."""
    words = F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"\\[A-Za-z@]+", " ")), r"[^\p{L}]+"))
    counts = documents.select(F.explode(words).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("c"))
    return [r["w"] for r in counts.orderBy(F.desc("c"), "w").limit(n).collect()]


def statistics(documents: DataFrame, common_list: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of each document's text, without preamble, comments, formulas and bibliography.

    A null or empty text has statistics of 0. Rows stay as they are: a
    document that comes twice has two rows. Other columns are not used.
    """
    d = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    d = d.select("doc_id", _replaced("t", r"\r\n?", "\n", "\r").alias("t"))
    start = F.instr("t", r"\begin{document}")
    d = d.select("doc_id", F.substring_index(F.when(start > 0, F.expr("substring(t, instr(t, '\\\\begin{document}') + 16)")).otherwise(F.col("t")), r"\end{document}", 1).alias("t"))
    d = d.select("doc_id", _replaced("t", r"%(?<!\\%)[^\n]*+", "", "%").alias("t"))
    t = F.regexp_replace("t", _ENV, "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, _BULLET, "•"), _MATH, "x")
    t = F.regexp_replace(t, rf"(?m)^[ \t]*\\(?:{_PREAMBLE})\b[^\n]*$", "")
    d = d.select("doc_id", t.alias("body"))
    # cells and entries are taken out first: what is left may hold sentences
    d = d.select("doc_id", "body", _replaced("body", _CELLS, "", _CELL_SIGNS, rf"(?m)^{_COMMAS}$").alias("uncelled"))
    d = d.select("doc_id", "body", "uncelled", _replaced("uncelled", _ENTRY, "", _ENTRY_SIGNS, rf"(?m)^[ ]*(?:{_ITEM})\r?$").alias("free"))
    plain = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(" ")), "{}~", F.regexp_replace("free", _COMMAND, ""))
    d = d.select("doc_id", "body", "uncelled", "free", F.regexp_replace(F.regexp_replace(plain, _DECIMAL, ""), r"\s+", " ").alias("plain"))
    size = lambda c: F.length(_without(c, " \n\t"))
    d = d.withColumn("n", size("body"))
    d = d.withColumn("n1", F.when(F.col("uncelled") == F.col("body"), F.col("n")).otherwise(size("uncelled")))
    d = d.withColumn("n2", F.when(F.col("free") == F.col("uncelled"), F.col("n1")).otherwise(size("free")))
    d = d.select(
        "doc_id",
        "body",
        F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " ").alias("w"),
        "n",
        "n1",
        "n2",
        F.length(_without("plain", " ")).alias("n3"),
        F.length(_without(F.regexp_replace("plain", _SENTENCE, ""), " ")).alias("n4"),
        F.split(F.lower("plain"), " ").alias("pw"),
    )
    words = F.when(F.col("n") > 0, F.size("w")).otherwise(0)
    lines = F.regexp_count("body", F.lit(r"(?md)^[^\n\S]*+\S"))
    d = d.withColumns({"words": words, "lines": lines})
    n = F.col("n")
    return d.select(
        "doc_id",
        n.alias("n_chars"),
        F.col("words").alias("n_words"),
        F.col("lines").alias("n_lines"),
        _ratio(n, F.col("words")).alias("mean_word_length"),
        _ratio(F.length(F.regexp_replace("body", r"[\p{L}\p{M}\p{N}\s]+", "")), n).alias("symbol_ratio"),
        _ratio(n - size(_without("body", "0123456789")), n).alias("digit_ratio"),
        _ratio(F.regexp_count("body", F.lit(r"(?m)[.!?][\"')}]{0,3}[ \t]*$")), F.col("lines")).alias("punctuated_lines"),
        _ratio(F.size(F.filter("pw", lambda x: x.isin(*common_list))), F.size("pw")).alias("common_words"),
        _ratio(F.col("n3") - F.col("n4"), n).alias("sentence_share"),
        _ratio(n - F.col("n1"), n).alias("cell_share"),
        _ratio(F.col("n1") - F.col("n2"), n).alias("entry_share"),
        _ratio(F.col("n2") - F.col("n3"), n).alias("command_share"),
        _ratio(F.size(F.array_distinct("w")), F.col("words")).alias("distinct_words"),
        _ratio(F.size(F.filter("w", lambda x: F.length(x) == 1)), F.col("words")).alias("single_letters"),
        _ratio(n, F.col("lines")).alias("mean_line_length"),
    )


# --- labels -------------------------------------------------------------------------------------------------------

_L_ENV = re.compile(rf"\\begin\{{({_ENVS})(\*?)\}}.*?(?:\\end\{{\1\2\}}|\Z)", re.S)
_L_MATH, _L_BULLET = re.compile(_MATH), re.compile(_BULLET)
_L_COMMENT = re.compile(r"(?m)(?<!\\)%.*$")
_L_PREAMBLE = re.compile(rf"(?m)^[ \t]*\\(?:{_PREAMBLE})\b.*$")
_L_MARK = re.compile(r"\s*(?:[-–—]{1,3}\s|[*+•·]\s|\\item|\\entry|\\glsentry|\(?\d{1,4}\s*[.):\-]\s|\(?[a-zA-Z][.)]\s)")
_L_LEADER = re.compile(r"\\dotfill|\.{4,}|\\\\\s*$")
_L_ROW = re.compile(r"\\\\\s*(?:\\hline)?\s*$")
_L_COMMAND = re.compile(r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?|\\.")
_L_SENTENCE = re.compile(r"[^.!?]*[.!?]+(?=\s|$|[\"')])")
_L_WORD = re.compile(r"[(\"'`]*[^\W\d_]+(?:[-'’][^\W\d_]+)*[,;:.!?)\"'`]*")
_SPACE = re.compile(r"\s")
PROSE = 0.2


def _cells(line: str) -> bool:
    if "\t" in line or line.count("|") >= 2 or "&" in line and _L_ROW.search(line):
        return True
    for sep in ",;":
        n = line.count(sep)
        if n >= 2 and len(re.findall(rf"{sep}\s*(?:[\d.]+|--)?(?={sep}|\s*$)", line)) >= 0.6 * n:
            return True
    return len(re.findall(r"\S {3,}(?=\S)", line)) >= 1


def _sentence(s: str) -> bool:
    words = s.split()
    plain = [w for w in words if _L_WORD.fullmatch(w)]
    return (
        len(words) >= 5
        and len(plain) >= 0.7 * len(words)
        and sum(w[0].islower() for w in plain) >= 0.5 * len(plain)
        and sum(len(w) > 1 for w in plain) > 0.6 * len(plain)
    )


def label(text: str | None) -> str:
    """``prose``, or the kind of a text of which less than a fifth is running prose: ``list``, ``table`` or ``junk``."""
    t = re.sub(r"\r\n?", "\n", text or "")
    _, mark, rest = t.partition(r"\begin{document}")
    t = (rest if mark else t).split(r"\end{document}")[0]
    t = _L_ENV.sub("\n\n", _L_COMMENT.sub("", t))
    t = _L_PREAMBLE.sub("", _L_MATH.sub("x", _L_BULLET.sub("•", t)))
    size = {"prose": 0, "table": 0, "list": 0, "junk": 0}
    seen: dict[str, int] = {}
    for part in re.split(r"\n[ \t]*\n", t):
        free = []
        for line in part.split("\n"):
            k = len(_SPACE.sub("", line))
            letters = sum(c.isalnum() for c in line)
            if not k:
                continue
            if letters < 0.4 * k and not _L_ROW.search(line):
                size["junk"] += k
            elif _cells(line):
                size["table"] += k
            elif _L_MARK.match(line) and len(line.split()) < 10 or _L_LEADER.search(line):
                size["list"] += k
            else:
                free.append(line)
        whole = " ".join(free)
        plain = re.sub(r"[{}~]", " ", _L_COMMAND.sub(" ", whole))
        got = 0
        for s in _L_SENTENCE.findall(plain):
            if _sentence(s):
                seen[s] = seen.get(s, 0) + 1
                # what is said over and over is repetition, not prose
                got += len(_SPACE.sub("", s)) * (seen[s] <= 2)
        size["prose"] += got
        size["junk"] += max(0, len(_SPACE.sub("", whole)) - got)
    total = sum(size.values())
    if total and size["prose"] >= PROSE * total:
        return "prose"
    return max(("table", "list", "junk"), key=lambda k: size[k] + (k == "junk") * 0.5)


# --- rules --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    kind: str
    #: (statistic, whether it must be at least the threshold, threshold)
    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, least, at in self.conditions:
            v = x[name].to_numpy()
            out &= v >= at if least else v < at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, least, at in self.conditions:
            out = out & ((F.col(name) >= at) if least else (F.col(name) < at))
        return out


def _grow(x: pd.DataFrame, y: np.ndarray, kind: str, cuts: dict[str, np.ndarray]) -> Rule:
    """Conditions are added while they raise FOIL's gain, until no negative is covered."""
    conditions: list[tuple[str, bool, float]] = []
    live = np.ones(len(x), bool)
    while (~y & live).any() and len(conditions) < 6:
        p0, n0 = int((y & live).sum()), int((~y & live).sum())
        base = np.log2(p0 / (p0 + n0))
        best = (1e-9, None)
        for name, at in cuts.items():
            v = x[name].to_numpy()[live]
            pos = np.sort(v[y[live]])
            neg = np.sort(v[~y[live]])
            p_less, n_less = np.searchsorted(pos, at, "left"), np.searchsorted(neg, at, "left")
            for least, p, n in ((False, p_less, n_less), (True, len(pos) - p_less, len(neg) - n_less)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, least, float(at[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        live &= Rule(kind, (best[1],)).covers(x)
    return Rule(kind, tuple(conditions))


def _prune(rule: Rule, x: pd.DataFrame, y: np.ndarray) -> Rule:
    """Last conditions are dropped where this raises (p - n) / (p + n) on rows that the rule wasn't grown on."""
    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = int((y & c).sum()), int((~y & c).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.kind, rule.conditions[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


#: Ways in which the sample is split into rows to grow on and rows to prune on.
SPLITS = 24


def predict(rules: list[Rule], x: pd.DataFrame) -> np.ndarray:
    out = np.full(len(x), "prose", object)
    for r in reversed(rules):
        out[r.covers(x)] = r.kind
    return out


def induce(x: pd.DataFrame, labels: np.ndarray) -> list[Rule]:
    """Of the rule lists of all splits the one with the fewest errors on a quarter of the sample that none was grown or pruned on, then on all, then the fewest conditions."""
    rng = np.random.default_rng(99)
    held = np.zeros(len(x), bool)
    for kind in np.unique(labels):
        at = rng.permutation(np.nonzero(labels == kind)[0])
        held[at[: len(at) // 4]] = True
    grown = x[~held].reset_index(drop=True)
    lists = [_induce(grown, labels[~held], seed) for seed in range(SPLITS)]
    wrong = {k: predict(r, x) != labels for k, r in enumerate(lists)}
    best = min(wrong, key=lambda k: (int(wrong[k][held].sum()), int(wrong[k].sum()), sum(len(c.conditions) for c in lists[k])))
    return lists[best]


def _induce(x: pd.DataFrame, labels: np.ndarray, seed: int, cuts_per_stat: int = 400) -> list[Rule]:
    """An ordered rule list: the kinds from the rarest on, each with rules until one is no better than a guess."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    kinds = [k for k in ("table", "list", "junk") if (labels == k).any()]
    for kind in sorted(kinds, key=lambda k: (labels == k).sum()):
        for _ in range(12):
            rows = np.nonzero(left)[0]
            if not (labels[rows] == kind).any():
                break
            rows = rng.permutation(rows)
            y = labels[rows] == kind
            # two thirds of either side to grow, the rest to prune
            side = np.zeros(len(rows), bool)
            for s in (True, False):
                at = np.nonzero(y == s)[0]
                side[at[: max(1, (2 * len(at) + 2) // 3)]] = True
            g, p = rows[side], rows[~side]
            cuts = {}
            for name in STATS:
                v = np.unique(x[name].to_numpy()[g])
                mid = (v[1:] + v[:-1]) / 2
                cuts[name] = mid if len(mid) <= cuts_per_stat else mid[np.linspace(0, len(mid) - 1, cuts_per_stat).astype(int)]
            rule = _grow(x.iloc[g], labels[g] == kind, kind, {k: v for k, v in cuts.items() if len(v)})
            if not rule.conditions:
                break
            rule = _prune(rule, x.iloc[p], labels[p] == kind) if len(p) else rule
            c = rule.covers(x) & left
            hit = int((labels[c] == kind).sum())
            # judged on rows that it wasn't grown on, where it covers any
            seen = p[rule.covers(x.iloc[p])]
            if not hit or (labels[seen] == kind).sum() < 0.5 * len(seen) or not len(seen) and hit < 0.5 * c.sum():
                break
            rules.append(rule)
            left &= ~c
    return rules


def case(rules: list[Rule]) -> Column:
    """The rules as one CASE expression; null where none applies, which is prose."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.column(), r.kind).otherwise(out)
    return out


def learn(documents: DataFrame, common: Sequence[str], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules from about ``sample`` labelled documents, chosen by the hash of their id (all, if there are fewer)."""
    n = documents.count()
    if not n:
        return []
    share = 1 << 50
    some = documents.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(share)) < min(share, sample * share // n)).select(doc_id, text)
    labelled = F.pandas_udf(lambda s: s.map(label), "string")
    stats = statistics(some.select(F.struct(F.col(doc_id).alias("id"), labelled(F.col(text)).alias("l")).alias("k"), text), common, "k", text)
    # sorted, so that neither partitions nor a retried task change the rules
    x = stats.select("doc_id.id", "doc_id.l", *STATS).toPandas().sort_values(["id", "l", "n_chars"], kind="stable").reset_index(drop=True)
    return induce(x[list(STATS)].astype(float), x["l"].to_numpy())


def kinds(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, with_statistics: bool = True) -> DataFrame:
    """The statistics of each document with its ``kind``: null for prose, else list, table or junk.

    A null or empty text has nothing to read and is judged by its statistics
    of 0, as empty texts in the sample are. An empty table gives no rows.
    Without statistics only those that the rules ask for are computed.
    """
    common = common_words(documents, text)
    rules = learn(documents, common, doc_id, text, sample)
    asked = {name for r in rules for name, _, _ in r.conditions}
    names = [n for n in STATS if with_statistics or n in asked] or ["n_chars"]
    s = statistics(documents, common, doc_id, text).select("doc_id", F.struct(*names).alias("_s"))
    # a filter on the kind would else be pushed below the statistics and compute them once for each mention
    s = s.select("doc_id", F.explode(F.array("_s")).alias("_s")).select("doc_id", "_s.*").withColumn("kind", case(rules))
    return s if with_statistics else s.select("doc_id", "kind")
