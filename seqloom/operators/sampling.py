"""Sampling from and fitting of small pairwise models, in parallel over groups and blocks of chains.

Chains are worked on in blocks of ``CHAINS``; each block has a counter-based
generator keyed by seed, group and block, so that neither the partitioning
nor a retried task changes the result. Fitting takes a group's frequencies (a
table bounded by columns and states, not rows) and runs inside one task for
each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.alignment import Q

CHAINS = 1024


def generator(seed: int, group: str, block: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFF, (crc32(group.encode()) << 20) ^ block]))


def metropolis(h: np.ndarray, j: np.ndarray | None, chains: int, steps: int, rng: np.random.Generator, start: np.ndarray | None = None) -> np.ndarray:
    """States of ``chains`` chains after ``steps`` proposals at one site each.

    ``h`` is columns x states, ``j`` columns x columns x states x states and
    symmetric, or None. A proposal is any other state of a random column; it
    is taken if it raises the log probability, else with the probability of the change.
    """
    width, q = h.shape
    x = rng.integers(0, q, (chains, width)) if start is None else start.copy()
    rows = np.arange(chains)
    for _ in range(steps):
        pos = rng.integers(0, width, chains)
        old = x[rows, pos]
        new = (old + 1 + rng.integers(0, q - 1, chains)) % q
        delta = h[pos, new] - h[pos, old]
        if j is not None:
            cols = np.arange(width)[None]
            cur = x
            other = cols != pos[:, None]
            up = j[pos[:, None], cols, new[:, None], cur]
            down = j[pos[:, None], cols, old[:, None], cur]
            delta = delta + np.where(other, up - down, 0).sum(axis=1)
        take = np.log(rng.random(chains)) < delta
        x[rows[take], pos[take]] = new[take]
    return x


def dense_tables(h: pd.DataFrame, j: pd.DataFrame | None) -> tuple[list[int], np.ndarray, np.ndarray | None]:
    """A group's parameter rows as arrays over its columns; absent fields are very low, absent couplings 0."""
    cols = sorted(h["pos"].unique())
    at = {c: k for k, c in enumerate(cols)}
    hd = np.full((len(cols), Q), -50.0)
    hd[h["pos"].map(at), h["state"]] = h["v"]
    if j is None:
        return cols, hd, None
    jd = np.zeros((len(cols), len(cols), Q, Q))
    i2, j2 = j["i"].map(at).to_numpy(), j["j"].map(at).to_numpy()
    a, b, v = j["a"].to_numpy(), j["b"].to_numpy(), j["v"].to_numpy()
    jd[i2, j2, a, b] = v
    jd[j2, i2, b, a] = v
    return cols, hd, jd


def sample(fields: DataFrame, couplings: DataFrame | None, sizes: DataFrame, steps: int, seed: int = 1, temperature: float = 1.0, group: str = "family") -> DataFrame:
    """group, chain, states (over the group's columns in order): as many chains as ``sizes`` has in ``n``.

    Parameters are packed to one row a group and joined to the blocks of chains.
    """
    packed_h = fields.groupBy(group).agg(F.collect_list(F.struct("pos", "state", "v")).alias("h"))
    if couplings is not None:
        packed_h = packed_h.join(couplings.groupBy(group).agg(F.collect_list(F.struct("i", "j", "a", "b", "v")).alias("j")), group, "left")
    blocks = sizes.select(group, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHAINS).cast("int"))).alias("block")).where("n > 0")
    x = blocks.join(packed_h, group)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                h = pd.DataFrame(list(r["h"]))
                j = pd.DataFrame(list(r["j"])) if r.get("j") is not None else None
                _, hd, jd = dense_tables(h, j)
                n = int(min(CHAINS, r["n"] - r["block"] * CHAINS))
                out = metropolis(hd / temperature, None if jd is None else jd / temperature, n, steps, generator(seed, r[group], r["block"]))
                yield pd.DataFrame({group: r[group], "chain": r["block"] * CHAINS + np.arange(n), "states": list(out.astype(np.int32))})

    return x.repartition(group, "block").mapInPandas(run, f"{group} string, chain long, states array<int>")


# --- fitting ------------------------------------------------------------------------------------------------------


def _pack(h: np.ndarray, j: np.ndarray) -> np.ndarray:
    up = np.triu_indices(len(h), 1)
    return np.concatenate([j[up].ravel(), h.ravel()])


def _unpack(w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.triu_indices(width, 1)
    n = len(up[0]) * Q * Q
    j = np.zeros((width, width, Q, Q))
    j[up] = w[:n].reshape(-1, Q, Q)
    j[up[1], up[0]] = j[up].transpose(0, 2, 1)
    return w[n:].reshape(width, Q), j


def statistics(x: np.ndarray) -> np.ndarray:
    """Packed frequencies of states and of state pairs."""
    n, width = x.shape
    hot = np.zeros((n, width * Q))
    hot[np.arange(n)[:, None], np.arange(width)[None] * Q + x] = 1
    two = (hot.T @ hot / n).reshape(width, Q, width, Q).transpose(0, 2, 1, 3)
    return _pack(hot.mean(axis=0).reshape(width, Q), two)


def direction(gradient: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient scaled by the curvature that the last moves showed (limited memory, two loops)."""
    d, alphas = gradient.copy(), []
    for s, y in reversed(moves):
        a = (s @ d) / (y @ s)
        alphas.append(a)
        d -= a * y
    if moves:
        s, y = moves[-1]
        d *= (s @ y) / (y @ y)
    for (s, y), a in zip(moves, reversed(alphas), strict=True):
        d += s * (a - (y @ d) / (y @ s))
    return -d


def fit_one(target: np.ndarray, width: int, group: str, iterations: int, chains: int, steps: int, lam: float, memory: int, seed: int) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Parameters whose sampled frequencies approach ``target``, and of each iteration the gradient's norm and the pairs' Pearson correlation."""
    n_pair = width * (width - 1) // 2 * Q * Q
    w = np.zeros(len(target))
    w[n_pair:] = np.log(np.maximum(target[n_pair:], 1.0 / (4 * chains)))
    history, moves, last = [], [], None
    for it in range(iterations):
        h, j = _unpack(w, width)
        model = statistics(metropolis(h, j, chains, steps, generator(seed, group, it)))
        g = model - target + 2 * lam * w
        x, y = model[:n_pair], target[:n_pair]
        seen = (x > 0) | (y > 0)
        pearson = float(np.corrcoef(x[seen], y[seen])[0, 1]) if seen.sum() > 2 and x[seen].std() > 0 and y[seen].std() > 0 else 0.0
        history.append((it, float(np.linalg.norm(g)), pearson))
        if last is not None:
            s, dg = w - last[0], g - last[1]
            if dg @ s > 1e-10:
                moves = [*moves, (s, dg)][-memory:]
        d = direction(g, moves)
        # sampled gradients are noisy: no step moves a parameter further than this
        d *= min(1.0, 1.0 / max(np.abs(d).max(), 1e-12))
        last = (w.copy(), g)
        w = w + d * (1.0 if moves else min(1.0, 1.0 / max(np.linalg.norm(g), 1e-12)))
    return w, history


def fit(single: DataFrame, pairs: DataFrame, totals: DataFrame, iterations: int = 8, chains: int = 256, steps: int = 300, lam: float = 0.01, memory: int = 5, seed: int = 3, group: str = "family") -> DataFrame:
    """group, iteration, gradient_norm, pearson: one model for each group, fitted to the frequencies at the chosen columns.

    The inputs are counts, so a group's task is bounded by its columns and
    states whatever its number of rows.
    """
    s = single.join(totals, group).groupBy(group).agg(F.collect_list(F.struct("pos", "state", (F.col("n") / F.col("total")).alias("f"))).alias("one"))
    p = pairs.join(totals, group).groupBy(group).agg(F.collect_list(F.struct("i", "j", "a", "b", (F.col("n") / F.col("total")).alias("f"))).alias("two"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                one, two = pd.DataFrame(list(r["one"])), pd.DataFrame(list(r["two"]))
                cols, h, j = dense_tables(one.rename(columns={"f": "v"}), two.rename(columns={"f": "v"}))
                target = _pack(np.maximum(h, 0), j)
                _, history = fit_one(target, len(cols), r[group], iterations, chains, steps, lam, memory, seed)
                out = pd.DataFrame(history, columns=["iteration", "gradient_norm", "pearson"]).astype({"iteration": "int32"})
                yield out.assign(**{group: r[group]})[[group, "iteration", "gradient_norm", "pearson"]]

    return s.join(p, group).repartition(group).mapInPandas(run, f"{group} string, iteration int, gradient_norm double, pearson double")


# --- principal components -----------------------------------------------------------------------------------------


def components(single: DataFrame, pairs: DataFrame, totals: DataFrame, k: int = 2, group: str = "family") -> DataFrame:
    """group, pos, state, component, loading: the first eigenvectors of the one-hot covariance at the chosen columns, gaps left out, the largest entry positive."""
    s = single.join(totals, group).groupBy(group).agg(F.max("total").alias("total"), F.collect_list(F.struct("pos", "state", "n")).alias("one"))
    p = pairs.groupBy(group).agg(F.collect_list(F.struct("i", "j", "a", "b", "n")).alias("two"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                one, two = pd.DataFrame(list(r["one"])), pd.DataFrame(list(r["two"]))
                one, two = one[one["state"] > 0].reset_index(drop=True), two[(two["a"] > 0) & (two["b"] > 0)]
                at = {key: n for n, key in enumerate(zip(one["pos"], one["state"], strict=True))}
                if not at or r["total"] < 2:
                    continue
                m = np.diag(one["n"].to_numpy(float))
                x = [at[key] for key in zip(two["i"], two["a"], strict=True)]
                y = [at[key] for key in zip(two["j"], two["b"], strict=True)]
                m[x, y] = m[y, x] = two["n"]
                mean = one["n"].to_numpy(float) / r["total"]
                cov = (m - r["total"] * np.outer(mean, mean)) / (r["total"] - 1)
                _, vectors = np.linalg.eigh(cov)
                for c in range(min(k, len(at))):
                    v = vectors[:, -1 - c]
                    v = v * np.sign(v[np.abs(v).argmax()])
                    yield pd.DataFrame({group: r[group], "pos": one["pos"], "state": one["state"], "component": np.int32(c), "loading": v})

    return s.join(p, group).repartition(group).mapInPandas(run, f"{group} string, pos int, state int, component int, loading double")


def project(cells: DataFrame, loadings: DataFrame, group: str = "family", key: str = "seq_id") -> DataFrame:
    """group, key, component, score: the rows' own (uncentred) coordinates."""
    x = cells.join(loadings, [group, "pos", "state"])
    return x.groupBy(group, key, "component").agg(F.sum("loading").alias("score"))
