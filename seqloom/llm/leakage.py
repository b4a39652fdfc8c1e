"""Test passages inside a training corpus: MinHash containment search and exact verification.

A case is a stretch of at least 12 consecutive words of a passage of which at
most one in ten was replaced or left out. The sets compared are those of
5-word shingles. Queries are the 12-word windows of the passages. Documents
are cut into overlapping segments, so that each such stretch lies whole in
one; the segments are partitioned by their number of shingles, and for each
partition the containment that a case has at least is turned into the Jaccard
similarity that it means there, and this into the number of minimum hashes
compared, so that a case at the very bound is missed with probability
``MISS``. Candidates are verified by exact shingle containment, then word by
word.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.textnorm import words

SHINGLE = 5
STRETCH = 12
ONE_IN = 10
STEP = 12
#: Words of a document that are hashed at once.
PIECE = 1024 * STEP
#: Shingles that a stretch of 12 words keeps at least when one word is replaced or left out.
KEPT = 3
QUERY = STRETCH - SHINGLE + 1
MISS = 2e-4
#: Upper bounds of the sizes by which segments are partitioned.
SIZES = (8, 14, 20)
#: Items worked on at a time: bounds what is sent to the tasks.
ITEM_BLOCK = 2_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashes_for(size: int) -> int:
    """Minimum hashes needed for segments of up to ``size`` shingles."""
    jaccard = KEPT / (QUERY + size - KEPT)
    return math.ceil(math.log(MISS) / math.log(1 - jaccard))


HASHES = [hashes_for(s) for s in SIZES]
_SEEDS = (np.arange(1, HASHES[-1] + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a sequence of word hashes."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + ids[i : i + n]
    return _mix(h)


def _tag(low: np.ndarray) -> np.ndarray:
    """Each hash function has its own range of values."""
    return low | (np.arange(low.shape[0], dtype=np.uint64) << np.uint64(48))[:, None]


class Queries:
    """The passages' windows, ready to be found."""

    def __init__(self, passages: Sequence[str]):
        self.words = [words(p) for p in passages]
        self.index: dict[str, int] = {}
        keys, owner = [], []
        self.shingles: list[set[int]] = []
        for k, ws in enumerate(self.words):
            ids = np.fromiter((crc32(w.encode()) for w in ws), np.uint64, len(ws))
            sh = shingle_hashes(ids)
            self.shingles.append(set(sh.tolist()))
            if len(ws) < STRETCH:
                continue
            values = (sh[None] * _SEEDS[:, None]) >> np.uint64(16)
            low = np.lib.stride_tricks.sliding_window_view(values, QUERY, axis=1).min(axis=2)
            keys.append(_tag(low).ravel())
            owner.append(np.full(low.size, k, np.int32))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner_all = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        order = np.lexsort((owner_all, self.keys))
        self.keys, self.owner = self.keys[order], owner_all[order]
        fresh = np.ones(len(self.keys), bool)
        fresh[1:] = (self.keys[1:] != self.keys[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.keys, self.owner = self.keys[fresh], self.owner[fresh]
        self.bits = 22
        self.there = np.zeros(1 << self.bits, bool)
        self.there[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Passages that may lie in the document, each with the starts (in words) of the segments in question.

        A long document is gone through piece by piece; pieces overlap by a segment.
        """
        out: dict[int, list[int]] = {}
        if len(self.keys):
            for at in range(0, max(1, len(ids)), PIECE):
                self._piece(ids[at : at + PIECE + 2 * STEP], at, out)
        return out

    def _piece(self, ids: np.ndarray, base: int, out: dict[int, list[int]]) -> None:
        sh = shingle_hashes(ids)
        if len(sh) < KEPT:
            return
        n = len(sh)
        starts = np.arange(0, n, STEP)
        # a segment is two steps of 12 words: 20 shingles
        sizes = np.minimum(n - starts, 2 * STEP - SHINGLE + 1)
        for k, size in enumerate(SIZES):
            part = np.nonzero((sizes <= size) & (sizes > (SIZES[k - 1] if k else 0)))[0]
            if not len(part):
                continue
            at = starts[part]
            cuts = np.stack([at, np.minimum(at + sizes[part], n)], axis=1).ravel()
            values = sh if part[0] == 0 else sh[at[0] :]
            cuts = cuts - (0 if part[0] == 0 else at[0])
            values = np.concatenate([values, values[-1:]])
            low = (values[None] * _SEEDS[: HASHES[k], None]) >> np.uint64(16)
            tagged = _tag(np.minimum.reduceat(low, cuts, axis=1)[:, ::2])
            hit = self.there[self._slot(tagged)]
            if not hit.any():
                continue
            _, seg = np.nonzero(hit)
            keys = tagged[hit]
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for s, a, b in zip(seg[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                for o in self.owner[a:b]:
                    out.setdefault(int(o), []).append(base + int(at[s]))

    def stretch(self, item: int, ids: np.ndarray, text: list[str], segments: list[int]) -> tuple[int, int] | None:
        """Length and errors of the longest stretch of the passage in the document, if there is one; of equal ones that with the fewest errors."""
        best = None
        own = self.shingles[item]
        passage = self.words[item]
        at = sorted(set(segments))
        begin = 0
        while begin < len(at):
            end = begin
            while end + 1 < len(at) and at[end + 1] - at[end] <= 4 * STEP:
                end += 1
            lo = max(0, at[begin] - len(passage))
            hi = min(len(text), at[end] + 2 * STEP + len(passage))
            begin = end + 1
            sh = shingle_hashes(ids[lo:hi])
            here = np.fromiter((int(h) in own for h in sh.tolist()), bool, len(sh))
            # exact containment: a case keeps at least so many shingles within a stretch
            if here.sum() < KEPT:
                continue
            near = np.nonzero(here)[0]
            region = text[lo + max(0, near[0] - len(passage)) : lo + near[-1] + SHINGLE + len(passage)]
            found = best_stretch(passage, region)
            if found and (best is None or (found[0], -found[1]) > (best[0], -best[1])):
                best = found
        return best


def best_stretch(passage: Sequence[str], text: Sequence[str]) -> tuple[int, int] | None:
    """The longest stretch of the passage in the text that is a case: its words and its errors.

    ``longest[e]`` has, for each place in the text, the words of the longest
    stretch with e errors that ends at the passage's current word and there.
    A stretch begins and ends with a word that is there.
    """
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(passage))}
    t = np.fromiter((vocabulary.get(w, -1) for w in text), np.int64, len(text))
    p = np.fromiter((vocabulary[w] for w in passage), np.int64, len(passage))
    most = len(p) // ONE_IN
    none = -(1 << 20)
    longest = np.full((most + 1, len(t) + 1), none)
    best = None
    for w in p:
        same = t == w
        new = np.full_like(longest, none)
        new[:, 1:] = np.where(same, longest[:, :-1] + 1, none)
        new[0, 1:] = np.where(same, np.maximum(new[0, 1:], 1), none)
        full = new.max(axis=1)
        for e in range(most + 1):
            if full[e] >= max(STRETCH, ONE_IN * e) and (best is None or (full[e], -e) > (best[0], -best[1])):
                best = int(full[e]), e
        for e in range(1, most + 1):
            new[e, 1:] = np.maximum(new[e, 1:], np.where(same, none, longest[e - 1, :-1] + 1))
            new[e] = np.maximum(new[e], longest[e - 1] + 1)
        longest = new
    return best


#: Queries of the blocks of items that a worker has made ready, the last ones used.
_READY: dict[str, Queries] = {}
MOST_READY = 2


def _ready(name: str, block: Sequence[str]) -> Queries:
    if name not in _READY:
        while len(_READY) >= MOST_READY:
            _READY.pop(next(iter(_READY)))
        _READY[name] = Queries(block)
    return _READY[name]


def _ids(ws: Sequence[str]) -> np.ndarray:
    return np.fromiter((crc32(w.encode()) for w in ws), np.uint64, len(ws))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """Documents with test material: doc_id, item_id, words and errors of the longest stretch found.

    All documents are searched whole; ``items`` is the stated set of queries,
    sent to the tasks in blocks of ``ITEM_BLOCK``. A document is read and
    hashed once, whatever the number of blocks. Items that share a passage
    are each reported. Null texts and passages, and passages of under 12
    words, have no cases; null ids are kept as they are. Of a document that
    comes twice, each row is reported. Other columns are not used. Empty
    tables give no rows.
    """
    spark = documents.sparkSession
    passages = items.where(F.col(passage).isNotNull()).select(F.col(passage).alias("p")).distinct().orderBy("p")
    blocks, block = [], []
    name = uuid.uuid4().hex

    def send() -> None:
        blocks.append((f"{name}-{len(blocks)}", spark.sparkContext.broadcast(list(block))))
        block.clear()

    for r in passages.toLocalIterator():
        block.append(r["p"])
        if len(block) == ITEM_BLOCK:
            send()
    if block:
        send()
    schema = documents.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("passage"), F.lit(0).alias("n_words"), F.lit(0).alias("n_errors")).schema

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            hashed = [_ids(words(t)) if t else None for t in f[text]]
            for key, texts in blocks:
                queries = _ready(key, texts.value)
                for d, t, ids in zip(f[doc_id], f[text], hashed, strict=True):
                    near = queries.candidates(ids) if ids is not None else None
                    if near:
                        ws = words(t)
                        for item, segments in near.items():
                            if hit := queries.stretch(item, ids, ws, segments):
                                found.append((d, texts.value[item], *hit))
            yield pd.DataFrame(found, columns=["doc_id", "passage", "n_words", "n_errors"]).astype({"n_words": "int32", "n_errors": "int32"})

    named = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage"))
    return documents.select(doc_id, text).mapInPandas(search, schema).join(named, "passage").select("doc_id", "item_id", "n_words", "n_errors")
