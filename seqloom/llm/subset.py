"""A varied subset of each family by minimum-cost flow over category combinations.

Each row gets three categories: its subfamily, the pivot row nearest to it,
and how complete it is. Rows are aggregated into combinations of these. For
each family a flow of ``n_select`` units from subfamilies through pivots to
classes of completeness is solved, in which each category has a target and
the cost of a unit grows with every unit that the category already has, so
that no large group takes over. The flow's unit counts of each combination
are then filled with its rows in the order of a hash.

Pivots are a bounded set: some rows of each family by the order of a hash,
then, round after round, some of the rows that are unlike all of these. All
rows are assigned; those unlike every pivot at the end are a subfamily of
their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import checkpoint, last_delivery, stored

#: Pivots a family in the first round and in each later one, and the most rounds.
FIRST, SECOND, ROUNDS = 96, 64, 4
#: Letters of all pivots up to which they are sent to all tasks; more are joined to their families' rows.
MOST_LETTERS = 64_000_000
#: Rows of a family that are held together where pivots are joined, and rows up to which a table is broadcast.
ROWS_A_TASK, MOST_BROADCAST = 20_000, 1_000_000
#: Columns that are compared at a time.
COLUMNS = 2_000
#: Letters that a batch holds as one matrix at most, the padding of shorter rows included.
CELLS = 4_000_000
#: Share of equal residues from which a row counts as of a pivot's kind.
ALIKE = 0.33
#: Fixed: letters of states 0 to 20.
LETTERS = np.frombuffer(b"-ACDEFGHIKLMNPQRSTVWY" + b"?" * 235, np.uint8)
COMPLETE, PARTIAL, FRAGMENT, COPY, EMPTY = range(5)
#: What a unit costs at its target, and what one that should only fill up costs.
W_SUBFAMILY, W_PIVOT, W_CLASS = 10.0, 1.0, 2.0
LAST_RESORT = {COPY: 1e4, EMPTY: 1e5}


def aligned(rows: DataFrame, keep: list[str], states: str = "states") -> DataFrame:
    """``keep`` and ``s``, the states as text with gaps; null stays null."""
    schema = rows.select(*keep, F.lit(None).cast("string").alias("s")).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(len(keep))
            flat = np.nan_to_num(col.flatten().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            gone = col.is_null().to_numpy(zero_copy_only=False)
            size = np.where(gone, 0, np.diff(col.offsets.to_numpy()))
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            letters = LETTERS[np.where((flat < 0) | (flat > 20), 21, flat)]
            text = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes()))
            text = pa.array(np.where(gone, None, text.to_numpy(zero_copy_only=False)), pa.string()) if gone.any() else text
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], text], names=[*keep, "s"])

    return rows.select(*keep, states).mapInArrow(make, schema)


def codes(texts: list[str], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Residues as 1 to 20 (0: gap or none) and the lengths; ``width`` columns, as many as the longest has by default."""
    raw = [t.encode("ascii", "replace") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    x = np.zeros((len(raw), int(size.max(initial=1))), np.uint8)
    x[np.arange(x.shape[1])[None] < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    look = np.zeros(256, np.uint8)
    look[LETTERS[1:21]] = np.arange(1, 21)
    x = look[x]
    if width is not None:
        x = x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return x, size


def bounded(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts whose matrix is bounded; one longer row is a part of its own."""
    size = f["s"].fillna("").str.len().to_numpy(np.int64)
    if len(f) * size.max(initial=0) <= CELLS:
        if len(f):
            yield f
        return
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        room = np.searchsorted(np.maximum(size[order[start:]], 1) * np.arange(1, len(order) - start + 1), CELLS, "right")
        yield f.iloc[order[start : start + max(1, int(room))]]
        start += max(1, int(room))


def _hot(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((x.shape[0], x.shape[1] * 20), np.float32)
    r, p = np.nonzero(x)
    out[r, p * 20 + x[r, p] - 1] = 1
    return out, (x > 0).astype(np.float32)


class Pivots:
    """Pivot rows, ready to be compared with others, some columns at a time."""

    def __init__(self, texts: list[str]):
        self.x, _ = codes(texts)
        self.n = (self.x > 0).sum(axis=1)
        width = self.x.shape[1]
        self.parts = [slice(k, min(k + COLUMNS, width)) for k in range(0, width, COLUMNS)]
        # of wide pivots nothing is kept ready: their matrices would be large
        self.ready = _hot(self.x) if len(self.parts) == 1 else None

    def identity(self, x: np.ndarray) -> np.ndarray:
        """Equal residues by positions at which both have one, rows x pivots; at least half of the shorter one must overlap. All columns count."""
        width = self.x.shape[1]
        least = np.minimum((x > 0).sum(axis=1)[:, None], self.n[None])
        # behind a pivot's end there is nothing that could be equal or overlap
        x = x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
        same, both = np.zeros((2, len(x), len(self.x)), np.float32)
        for part in self.parts:
            a, na = _hot(x[:, part])
            hot, there = self.ready or _hot(self.x[:, part])
            same += a @ hot.T
            both += na @ there.T
        return np.where(both >= np.maximum(0.5 * least, 1), same / np.maximum(both, 1), 0).astype(np.float32)


def leaders(pivots: list[str]) -> list[int]:
    """The subfamily of each pivot: that of the first leader that it is alike, else its own."""
    p = Pivots(pivots)
    like = p.identity(p.x)
    heads: list[int] = []
    out = []
    for k in range(len(pivots)):
        near = max(heads, key=lambda h: like[k, h], default=None)
        if near is None or like[k, near] < ALIKE:
            heads.append(k)
            near = k
        out.append(heads.index(near))
    return out


def _top(rows: DataFrame, per_family: int) -> DataFrame:
    """family, s: texts of up to ``per_family`` rows of each family, by the order of a hash, equal ones once; the limit works before the shuffle."""
    w = Window.partitionBy("family").orderBy("o", "s")
    some = rows.select("family", "s", F.xxhash64("seq_id").alias("o")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * per_family)
    once = some.groupBy("family", "s").agg(F.min("r").alias("o"))
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_family).select("family", "s")


#: Columns of rows to be judged, and of those that are unlike every pivot, which keep their texts.
JUDGED, UNLIKE = ["seq_id", "family", "loaded", "h", "h2"], ["seq_id", "family", "s"]


def _judge(f: pd.DataFrame, pivots_of, unlike: bool) -> pd.DataFrame:
    """The rows of a batch with the nearest pivot (-1: none that is alike) and how complete they are, or only those ``unlike`` every pivot."""
    pivot, near, kind = np.full(len(f), -1, np.int32), np.zeros(len(f), np.float32), np.full(len(f), EMPTY, np.int32)
    x, size = codes(list(f["s"].fillna("")))
    n = (x > 0).sum(axis=1)
    full = n > 0
    kind[full] = np.digitize(1 - n[full] / size[full], [0.1, 0.4])
    for fam, at in f.groupby("family", sort=False).indices.items():
        at, pivots = at[full[at]], pivots_of(fam)
        for b in range(0, len(at) if pivots else 0, 1024):
            k = at[b : b + 1024]
            like = pivots.identity(x[k])
            near[k] = like.max(axis=1)
            pivot[k] = np.where(near[k] >= ALIKE, like.argmax(axis=1), -1)
    return f.loc[full & (pivot < 0), UNLIKE] if unlike else f[JUDGED].assign(**{"pivot": pivot, "class": kind})


def _assign(rows: DataFrame, pivots: DataFrame, unlike: bool = False) -> DataFrame:
    """``_judge`` for all rows. ``pivots`` has a row for each family: family, texts.

    Few pivots are sent to all tasks; where they are more than
    ``MOST_LETTERS``, each family's are joined to parts of its rows.
    """
    schema = (rows.select(*UNLIKE) if unlike else rows.select(*JUDGED, F.lit(0).alias("pivot"), F.lit(0).alias("class"))).schema
    letters = pivots.select(F.sum(F.length(F.array_join("texts", ""))).alias("n")).first()["n"] or 0
    if letters <= MOST_LETTERS:
        shared = rows.sparkSession.sparkContext.broadcast({r["family"]: r["texts"] for r in pivots.toLocalIterator()})

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ready: dict[str, Pivots] = {}

            def of(family: str) -> Pivots | None:
                if family not in ready and shared.value.get(family):
                    ready[family] = Pivots(shared.value[family])
                return ready.get(family)

            for f in (part for f in frames for part in bounded(f)):
                yield _judge(f, of, unlike)

        return rows.mapInPandas(make, schema)
    parts = rows.groupBy("family").agg(F.ceil(F.count("*") / ROWS_A_TASK).cast("int").alias("_n"))
    left = rows.join(parts, "family").withColumn("_part", F.pmod(F.xxhash64("seq_id"), F.col("_n")).cast("int")).drop("_n")
    right = pivots.join(parts, "family").select("family", "texts", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_part"))

    def both(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        own = Pivots(list(p["texts"].iloc[0])) if len(p) else None
        done = [_judge(part, lambda _: own, unlike) for part in bounded(f)]
        return pd.concat(done, ignore_index=True) if done else _judge(f, lambda _: own, unlike)

    return left.groupBy("family", "_part").cogroup(right.groupBy("family", "_part")).applyInPandas(both, schema)


def solve(combos: pd.DataFrame, n: int) -> pd.Series:
    """Units for each combination (subfamily, pivot, class, count): a minimum-cost flow of ``n`` units, or of all rows.

    Successive shortest paths; the cost of an arc's next unit grows with its
    flow, so every path found keeps the flow optimal.
    """
    combos = combos.reset_index(drop=True)
    n = int(min(n, combos["count"].sum()))
    subs = combos.groupby("subfamily")["count"].sum()
    node = {("s",): 0, ("t",): 1}
    arcs: list[list] = []  # from, to, capacity, first cost, growth, flow
    out: list[list[int]] = [[], []]

    def at(*key) -> int:
        if key not in node:
            node[key] = len(node)
            out.append([])
        return node[key]

    def arc(a: int, b: int, capacity: int, first: float, growth: float) -> int:
        arcs.append([a, b, capacity, first, growth, 0])
        out[a].append(len(arcs) - 1)
        out[b].append(len(arcs) - 1)
        return len(arcs) - 1

    target = n / max(1, len(subs))
    for s, c in subs.items():
        # of groups that are even otherwise, the larger comes first
        arc(0, at("a", s), n, -0.01 * math.log(c + 1), W_SUBFAMILY / max(target, 0.5))
    for s, mine in combos.groupby("subfamily"):
        for p, c in mine.groupby("pivot")["count"].sum().items():
            arc(at("a", s), at("b", s, p), n, -0.001 * math.log(c + 1), W_PIVOT / max(target / mine["pivot"].nunique(), 0.5))
    usual = combos[combos["class"] < COPY].groupby("class")["count"].sum()
    total = np.sqrt(usual).sum()
    for k in sorted(combos["class"].unique()):
        if k in LAST_RESORT:
            arc(at("c", k), 1, n, LAST_RESORT[k], 0.0)
        else:
            arc(at("c", k), 1, n, 0.0, W_CLASS / max(n * math.sqrt(usual[k]) / total, 0.5))
    mine = [arc(at("b", r.subfamily, r.pivot), at("c", r.kind), int(r.count_), 0.0, 0.0) for r in combos.rename(columns={"class": "kind", "count": "count_"}).itertuples()]
    potential = [0.0] * len(node)
    # costs of empty arcs may be negative: one round of relaxation in the order of the layers gives potentials
    order = sorted(node, key=lambda k: "sabct".index(k[0]))
    dist = [math.inf] * len(node)
    dist[0] = 0.0
    for key in order:
        v = node[key]
        for e in out[v]:
            a, b, cap, first, growth, _ = arcs[e]
            if a == v and cap and dist[v] + first < dist[b]:
                dist[b] = dist[v] + first
    potential = [d if d < math.inf else 0.0 for d in dist]
    for _ in range(n):
        dist = [math.inf] * len(node)
        back = [-1] * len(node)
        dist[0] = 0.0
        heap = [(0.0, 0)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v] + 1e-12:
                continue
            for e in out[v]:
                a, b, cap, first, growth, flow = arcs[e]
                if a == v and flow < cap:
                    cost, to = first + growth * flow, b
                elif b == v and flow > 0:
                    cost, to = -(first + growth * (flow - 1)), a
                else:
                    continue
                nd = d + max(0.0, cost + potential[v] - potential[to])
                if nd < dist[to] - 1e-12:
                    dist[to], back[to] = nd, e
                    heapq.heappush(heap, (nd, to))
        if dist[1] == math.inf:
            break
        potential = [p + (d if d < math.inf else 0.0) for p, d in zip(potential, dist, strict=True)]
        v = 1
        while v:
            e = back[v]
            if arcs[e][1] == v:
                arcs[e][5] += 1
                v = arcs[e][0]
            else:
                arcs[e][5] -= 1
                v = arcs[e][1]
    return pd.Series([arcs[e][5] for e in mine], index=combos.index)


def varied_subset(rows: DataFrame, sizes: DataFrame, key: str = "seq_id", family: str = "family", states: str = "states", loaded: str = "loaded_at", wanted: str = "n_select") -> dict[str, DataFrame]:
    """A varied subset of each family's rows.

    ``sizes`` has a row for each family (of the same family the largest
    size counts). Result: ``selected`` (family, seq_id, subfamily, pivot,
    class) and ``combinations`` (family, subfamily, pivot, class, count,
    quota). A family with fewer rows than wanted comes out whole; otherwise
    rows equal to a chosen one, null rows and rows without residues are only
    taken where nothing else is left. Families without a size, rows without a
    key or family, and null or non-positive sizes select nothing. Ties are
    settled by the hash of the key, then the key. Of several deliveries the
    last counts. Other columns are not used; empty tables give empty results.
    """
    base = rows.where(F.col(key).isNotNull() & F.col(family).isNotNull())
    text = aligned(base.select(F.col(key).alias("seq_id"), F.col(family).alias("family"), F.col(loaded).alias("loaded"), F.col(states).alias("states")), ["seq_id", "family", "loaded"])
    text = text.withColumns({"h": F.xxhash64(F.coalesce("s", F.lit(""))), "h2": F.xxhash64(F.reverse(F.coalesce("s", F.lit(""))))})
    want = sizes.where(F.col(wanted) > 0).groupBy(F.col(family).alias("family")).agg(F.max(wanted).cast("int").alias("n_select"))
    seen = text.where(F.translate(F.coalesce("s", F.lit("")), "-", "") != "")
    # a family's pivots in a row; of a bounded number of rounds each looks only at the rows that are unlike all pivots so far
    packed = lambda p: p.groupBy("family").agg(F.sort_array(F.collect_list("s")).alias("texts"))
    new = packed(_top(seen, FIRST))
    pivots = checkpoint(new)
    far, found = seen.select(*UNLIKE), pivots
    for _ in range(ROUNDS - 1):
        # the few rows that are unlike every pivot so far
        far = stored(_assign(far, found, unlike=True))
        if far.isEmpty():
            break
        found = checkpoint(packed(_top(far, SECOND)))
        both = pivots.join(found.withColumnRenamed("texts", "more"), "family", "full")
        pivots = checkpoint(both.select("family", F.concat(F.coalesce("texts", F.array()), F.coalesce("more", F.array())).alias("texts")))

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for family, texts in zip(f["family"], f["texts"], strict=True):
                g = leaders(list(texts))
                yield pd.DataFrame({"family": family, "pivot": np.arange(len(g), dtype=np.int32), "subfamily": np.array(g, np.int32)})

    subfamily = checkpoint(pivots.mapInPandas(lead, "family string, pivot int, subfamily int"))
    last = stored(last_delivery(_assign(text, pivots), "seq_id", "loaded", ["family", "h", "h2", "pivot", "class"]))
    # texts that come several times: the first row stands for them, the others are copies
    texts = ["family", "h", "h2"]
    first = checkpoint(last.where(F.col("class") != EMPTY).groupBy(*texts).agg(F.min("seq_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = F.broadcast(first) if first.count() <= MOST_BROADCAST else first
    cat = last.join(first, texts, "left").join(want.select("family"), "family", "left_semi")
    cat = cat.withColumn("class", F.when((F.col("class") != EMPTY) & (F.col("first") != F.col("seq_id")), COPY).otherwise(F.col("class")))
    subfamily = F.broadcast(subfamily) if subfamily.count() <= MOST_BROADCAST else subfamily
    cat = cat.join(subfamily, ["family", "pivot"], "left").select("family", "seq_id", F.coalesce("subfamily", F.lit(-1)).alias("subfamily"), "pivot", "class")
    names = ["family", "subfamily", "pivot", "class"]
    counts = cat.groupBy(*names).agg(F.count("*").alias("count")).join(want, "family")

    def quotas(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["subfamily", "pivot", "class"]).reset_index(drop=True)
        return f.assign(family=str(f["family"].iloc[0]), quota=solve(f[["subfamily", "pivot", "class", "count"]], int(f["n_select"].iloc[0])).astype("int32"))[[*names, "count", "quota"]]

    # little data, but work for each family: not to be put together in one task
    spread = counts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "family")
    combos = spread.groupBy("family").applyInPandas(quotas, "family string, subfamily int, pivot int, class int, count long, quota int")
    most = want.agg(F.max("n_select")).first()[0] or 0
    order = Window.partitionBy(*names).orderBy(F.xxhash64("seq_id"), "seq_id")
    ranked = cat.withColumn("r", F.row_number().over(order)).where(F.col("r") <= int(most))
    chosen = ranked.join(combos.select(*names, "quota"), names).where("r <= quota")
    return {"selected": chosen.select("family", "seq_id", "subfamily", "pivot", "class"), "combinations": combos}
