"""Mixing sources to target weights by subset-sum budget fitting.

For each plan and source there is a budget of tokens. Whole rounds over the
source come first, as far as the cap on repeats allows; what then remains is
smaller than the source. Documents in the order of a seeded hash fill it up to
a rest that some hundred documents can fill; of these the numbers by exact
token length are counted, and bounded-knapsack dynamic programming over the
lengths finds how many documents of each length come closest to the rest from
below. That many are taken, again in the order of the hash. Documents that
are large beside the rest don't count when the pool is measured.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.session import checkpoint

#: Ranks of a public byte-level vocabulary; the path is a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pattern by which this vocabulary's texts are cut into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slots of the seeded hash on each level, and the levels; a slot of the last one has few documents of even a very large source.
SLOTS, LEVELS = 1024, 3
#: Documents from which the last rest is filled, and the part of their tokens that the rest is to be.
POOL = 240
REST = 0.4
#: Rows up to which a table of plans is broadcast.
MOST_BROADCAST = 100_000


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, zlib.decompress(data).splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; 0 for null. The vocabulary is read where the query is planned and sent to the tasks."""
    with open(path, "rb") as f:
        ranks = SparkSession.active().sparkContext.broadcast(zlib.compress(f.read()))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(ranks.value).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")(text)


def spelled(source: Column) -> Column:
    """A source's name without regard to case, blanks around it, and the sign between its words."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")


def _parts(counts: dict[int, int], rest: int) -> list[tuple[int, int]]:
    """Lengths with numbers of documents that are taken whole or not: a length's count in powers of two."""
    out = []
    for length in sorted(k for k in counts if 0 < k <= rest):
        left, part = min(counts[length], rest // length), 1
        while left:
            take = min(part, left)
            out.append((length, take))
            left -= take
            part *= 2
    return out


def _split(parts: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """Those of the parts that sum to ``total``, which can be reached: half by half, so that only a few tables are kept at a time."""
    if not total:
        return []
    if len(parts) == 1:
        return parts
    half = len(parts) // 2
    window = (1 << (total + 1)) - 1
    up, down = 1, 1 << total
    for length, take in parts[:half]:
        up |= (up << (length * take)) & window
    for length, take in parts[half:]:
        down |= down >> (length * take)
    at = (up & down).bit_length() - 1
    return _split(parts[:half], at) + _split(parts[half:], total - at)


def knapsack(counts: dict[int, int], rest: int) -> dict[int, int]:
    """How many of each length sum to as near below ``rest`` as can be, by bounded-knapsack dynamic programming.

    The reachable sums are the bits of a number. Exact for every rest; the
    time grows with the rest times the number of lengths, the memory with
    the rest alone.
    """
    if rest <= 0:
        return {}
    window = (1 << (rest + 1)) - 1
    reach, parts = 1, []
    for length, take in _parts(counts, rest):
        parts.append((length, take))
        reach |= (reach << (length * take)) & window
        if reach >> rest & 1:
            break
    out: dict[int, int] = {}
    for length, take in _split(parts, reach.bit_length() - 1):
        out[length] = out.get(length, 0) + take
    return out


def _budgets(targets: DataFrame, sizes: dict[str, int], corpus: int) -> pd.DataFrame:
    """One row a plan and source: share of the plan, budget in tokens, cap, whole rounds, and what then remains."""
    t = targets.select("plan_name", spelled(F.col("source")).alias("source"), "target_share", "max_repeats", "size_factor").toPandas()
    t = t[t["plan_name"].notna() & t["source"].notna()].copy()
    t["target_share"] = t["target_share"].astype(float).fillna(0).clip(lower=0)
    # of a source named twice the shares add up and the tighter cap holds
    t["cap"] = t["max_repeats"].astype(float).fillna(float("inf"))
    g = t.groupby(["plan_name", "source"], as_index=False).agg(target_share=("target_share", "sum"), cap=("cap", "min"))
    factor = t.groupby("plan_name")["size_factor"].max().astype(float).fillna(1.0)
    total = g.groupby("plan_name")["target_share"].transform("sum")
    g["target_share"] = (g["target_share"] / total).where(total > 0, 0.0)
    g["size"] = g["source"].map(sizes).fillna(0).astype("int64")
    g["budget"] = (g["target_share"] * g["plan_name"].map(factor) * corpus).round().astype("int64")
    rounds = [min(b // s, c) if s else 0 for b, s, c in zip(g["budget"], g["size"], g["cap"], strict=True)]
    g["rounds"] = [max(0, int(r)) for r in rounds]
    more = (g["cap"] > g["rounds"]) & (g["size"] > 0)
    g["rest"] = (g["budget"] - g["rounds"] * g["size"]).where(more, 0).clip(lower=0).astype("int64")
    return g


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20) -> dict[str, DataFrame]:
    """For each plan a selection of documents in which each source has its share.

    The size of a plan is ``size_factor`` times the corpus in tokens. Result:
    ``selected`` (plan_name, source, doc_id, n_tokens, times) and ``report``
    (plan_name, source, target_share, target_tokens, max_repeats, documents,
    tokens, share), the share being that of the tokens selected. Where a
    source is absent, or its cap doesn't let it fill its budget, the report
    shows what is missing; no other source takes it over. Shares are taken
    relative to the plan's sum; null or negative ones count as 0, a null cap
    as none, a null factor as 1. Documents without id or source are part of
    the corpus' size, but of no source; those without tokens are not
    selected. Documents with the same id are one, the longest, in the
    corpus' size, too.
    """
    spark = documents.sparkSession
    d = documents.select(F.col(doc_id).alias("doc_id"), spelled(F.col(source)).alias("source"), token_count(F.col(text), tokenizer).alias("n_tokens"))
    d = checkpoint(d)
    longest = d.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.*")
    corpus = (longest.agg(F.sum("n_tokens")).first()[0] or 0) + (d.where("doc_id is null").agg(F.sum("n_tokens")).first()[0] or 0)
    own = longest.where("source is not null and n_tokens > 0")
    by_source = own.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(targets.select(spelled(F.col("source")).alias("source")).distinct(), "source", "left_semi")
    plan = _budgets(targets, {r["source"]: r["n"] for r in by_source.collect()}, corpus)
    fields = "plan_name string, source string"

    def planned(rows: list[tuple], schema: str) -> DataFrame:
        """A table with a few rows for each plan and source."""
        df = spark.createDataFrame(rows, f"{fields}, {schema}")
        return F.broadcast(df) if len(rows) <= MOST_BROADCAST else df

    wanted = plan[plan["rest"] > 0]
    some = planned([(r.plan_name, r.source, r.rest) for r in wanted.itertuples()], "rest long")
    slot = F.pmod(F.xxhash64(F.lit(seed), "plan_name", "doc_id"), F.lit(SLOTS**LEVELS))
    spread = own.join(some, "source").where("n_tokens <= rest").drop("rest").withColumns({"at": slot.cast("int")})

    # documents that don't count for the pool are over a quarter of the least rest that it has to fill
    means = {(r["plan_name"], r["source"]): r["mean"] for r in spread.groupBy("plan_name", "source").agg(F.avg("n_tokens").alias("mean")).collect()}
    large = [(r.plan_name, r.source, int(min(REST * POOL * means[r.plan_name, r.source], r.rest) / 4)) for r in wanted.itertuples() if (r.plan_name, r.source) in means]
    spread = spread.join(planned(large, "large long"), ["plan_name", "source"]).withColumn("small", F.col("n_tokens") <= F.col("large")).drop("large")
    sums = [F.sum("n_tokens").alias("n"), F.count("*").alias("c"), F.sum(F.when(F.col("small"), F.col("n_tokens")).otherwise(0)).alias("n_small"), F.count_if("small").alias("c_small")]

    # level by level: the slot in which the rest runs out less the pool, then the slots within that one
    cut: dict[tuple[str, str], dict] = {(r.plan_name, r.source): {"lo": 0, "sum": 0, "rest": r.rest} for r in wanted.itertuples()}
    levels: list[tuple[int, pd.DataFrame]] = []
    inner = spread
    for level in range(LEVELS):
        width = SLOTS ** (LEVELS - 1 - level)
        for c in cut.values():
            c.setdefault("ends", []).append((int(c["lo"]) // (width * SLOTS) + 1) * width * SLOTS)
        if level:
            edges = planned([(p, s, int(c["lo"] // (width * SLOTS))) for (p, s), c in cut.items()], "b int")
            inner = inner.join(edges, ["plan_name", "source"]).where(F.floor(F.col("at") / (width * SLOTS)) == F.col("b")).drop("b")
        levels.append((width, inner.groupBy("plan_name", "source", F.floor(F.col("at") / width).cast("int").alias("b")).agg(*sums).toPandas()))
        _advance(cut, levels[-1][1], width)
    _close(cut, levels)

    # what is taken without regard to lengths, and the pool from which the rest is filled
    pools = planned([(p, s, int(c["lo"]), int(c["hi"]), int(c["rest"] - c["sum"])) for (p, s), c in cut.items()], "lo int, hi int, left long")
    placed = spread.join(pools, ["plan_name", "source"]).where("at < hi")
    pool = placed.where("at >= lo").select("plan_name", "source", "doc_id", "n_tokens", "at", "left")
    lengths = pool.groupBy("plan_name", "source", "n_tokens").agg(F.count("*").alias("c"), F.max("left").alias("left"))

    def fill(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        counts = {int(k): int(v) for k, v in zip(f["n_tokens"], f["c"], strict=True)}
        got = knapsack(counts, int(f["left"].iloc[0]))
        return pd.DataFrame({"plan_name": key[0], "source": key[1], "n_tokens": list(got.keys()), "take": list(got.values())})

    # a pool is bounded, and each is solved in a task of its own
    taken = checkpoint(lengths.groupBy("plan_name", "source").applyInPandas(fill, f"{fields}, n_tokens long, take long"))

    # a rest that a pool's lengths don't make up is filled from more documents: all behind, then also more and more of those before
    met = {(r["plan_name"], r["source"]): r["n"] for r in taken.groupBy("plan_name", "source").agg(F.sum(F.col("n_tokens") * F.col("take")).alias("n")).collect()}
    open_ = [key for key, c in cut.items() if met.get(key, 0) < c["rest"] - c["sum"] and (c["lo"] or c["hi"] < SLOTS**LEVELS)]
    if open_:
        more = _wider(spread, {key: cut[key]["rest"] for key in open_}, {key: int(cut[key]["lo"]) for key in open_}, planned)
        for key, (lo, left) in more.items():
            cut[key] |= {"lo": lo, "hi": SLOTS**LEVELS, "sum": cut[key]["rest"] - left}
        pools = planned([(p, s, int(c["lo"]), int(c["hi"]), int(c["rest"] - c["sum"])) for (p, s), c in cut.items()], "lo int, hi int, left long")
        placed = spread.join(pools, ["plan_name", "source"]).where("at < hi")
        pool = placed.where("at >= lo").select("plan_name", "source", "doc_id", "n_tokens", "at", "left")
        lengths = pool.groupBy("plan_name", "source", "n_tokens").agg(F.count("*").alias("c"), F.max("left").alias("left"))
        taken = lengths.groupBy("plan_name", "source").applyInPandas(fill, f"{fields}, n_tokens long, take long")
    rank = F.row_number().over(Window.partitionBy("plan_name", "source", "n_tokens").orderBy("at", "doc_id"))
    extra = placed.where("at < lo").select("plan_name", "source", "doc_id").unionByName(
        pool.withColumn("r", rank).join(taken, ["plan_name", "source", "n_tokens"]).where("r <= take").select("plan_name", "source", "doc_id")
    )
    rounds = planned([(r.plan_name, r.source, r.rounds) for r in plan.itertuples() if r.rounds], "times int")
    whole = own.join(rounds, "source").select("plan_name", "source", "doc_id", "times")
    uses = whole.unionByName(extra.withColumn("times", F.lit(1))).groupBy("plan_name", "source", "doc_id").agg(F.sum("times").cast("int").alias("times"))
    selected = uses.join(own.select("doc_id", "n_tokens"), "doc_id").select("plan_name", "source", "doc_id", "n_tokens", "times")

    got = selected.groupBy("plan_name", "source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"))
    rows = [(r.plan_name, r.source, float(r.target_share), int(r.budget), None if r.cap == float("inf") else int(r.cap)) for r in plan.itertuples()]
    report = spark.createDataFrame(rows, fields + ", target_share double, target_tokens long, max_repeats int").join(got, ["plan_name", "source"], "left")
    report = report.withColumns({"documents": F.coalesce("documents", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy("plan_name")).cast("double"))
    return {"selected": selected, "report": report.withColumn("share", F.coalesce(share, F.lit(0.0)))}


def _wider(spread: DataFrame, rests: dict[tuple[str, str], int], los: dict[tuple[str, str], int], planned: Callable[[list[tuple], str], DataFrame]) -> dict[tuple[str, str], tuple[int, int]]:
    """For each plan and source, the slot from which on all documents are given to the knapsack, and what they are then to fill.

    The slot moves to the beginning by halves until the rest is met; at 0 the
    knapsack is over all documents, and nothing comes closer.
    """
    fields = "plan_name string, source string"
    done: dict[tuple[str, str], tuple[int, int]] = {}
    while los:
        at = planned([(p, s, lo, rests[p, s]) for (p, s), lo in los.items()], "lo int, rest long")
        mine = spread.join(at, ["plan_name", "source"])
        before = F.coalesce(F.sum(F.when(F.col("at") < F.col("lo"), F.col("n_tokens"))), F.lit(0))
        left = mine.groupBy("plan_name", "source").agg((F.max("rest") - before).alias("left"))
        lengths = mine.where("at >= lo").groupBy("plan_name", "source", "n_tokens").agg(F.count("*").alias("c")).join(left, ["plan_name", "source"])

        def fill(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            rest = int(f["left"].iloc[0])
            got = knapsack({int(k): int(v) for k, v in zip(f["n_tokens"], f["c"], strict=True)}, rest)
            return pd.DataFrame({"plan_name": key[0], "source": key[1], "left": [rest], "n": [sum(k * v for k, v in got.items())]})

        got = {(r["plan_name"], r["source"]): (r["left"], r["n"]) for r in lengths.groupBy("plan_name", "source").applyInPandas(fill, f"{fields}, left long, n long").collect()}
        ahead = {}
        for key, lo in los.items():
            rest, n = got.get(key, (0, -1))
            if n == rest or not lo:
                done[key] = (lo, rest)
            else:
                ahead[key] = lo // 2
        los = ahead
    return done


def _advance(cut: dict[tuple[str, str], dict], slots: pd.DataFrame, width: int) -> None:
    """Moves each cut over whole slots as long as a rest that a pool can fill stays."""
    for key, mine in slots.groupby(["plan_name", "source"]):
        c = cut[key]
        mine = mine.sort_values("b")
        for b, n, k in zip(mine["b"], mine["n"], mine["c"], strict=True):
            c.setdefault("mean", float(mine["n"].sum() / mine["c"].sum()))
            if c["sum"] + n > c["rest"] - REST * POOL * c["mean"]:
                c["lo"] = int(b) * width
                break
            c["sum"] += int(n)
            c["lo"] = (int(b) + 1) * width
            del k


def _close(cut: dict[tuple[str, str], dict], levels: list[tuple[int, pd.DataFrame]]) -> None:
    """The end of each pool: so far that it holds ``POOL`` documents and the rest, large ones not counted, or all there are."""
    for key, c in cut.items():
        seen = total = 0
        c["hi"] = SLOTS**LEVELS
        need = c["rest"] - c["sum"]
        # from the cut on in the slots of the last level, then in the coarser ones behind those
        steps, begin = [], int(c["lo"])
        for (width, slots), last in zip(reversed(levels), reversed(c["ends"]), strict=True):
            mine = slots[(slots["plan_name"] == key[0]) & (slots["source"] == key[1]) & (slots["b"] * width >= begin)].sort_values("b")
            steps += [((int(b) + 1) * width, n, k) for b, n, k in zip(mine["b"], mine["n_small"], mine["c_small"], strict=True)]
            begin = max(begin, last)
        for end, n, k in steps:
            seen, total = seen + k, total + n
            if seen >= POOL and total >= 1.5 * need:
                c["hi"] = end
                break
