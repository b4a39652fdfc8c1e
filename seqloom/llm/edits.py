"""Whether two sequences are near duplicates: edits, and at most one block moved.

Pairs are worked on together as padded matrices. Bounds that no near duplicate
exceeds come first, then the banded edit distance, then a search for the move
along diagonals on which runs of letters agree. What the search leaves open is
settled exactly: by the stretches of one text that the other lacks, of which
each holds an edit or a cut, and then by filling the tables of all moves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

TENTH = 10
#: Places at which a move cuts a text.
CUTS = 3
#: Letters that are held as one matrix at most, the padding of shorter rows included; one longer row is held alone.
CELLS = 4_000_000


def budget(length):
    """Edits allowed for the longer length."""
    return length // TENTH


def encode(seqs: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as small integers, padded with 0, and the lengths."""
    raw = [s.encode("ascii", "replace") for s in seqs]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    return padded(np.frombuffer(b"".join(raw), np.uint8), size), size


def padded(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(size), max(int(size.max(initial=0)), 1)), np.uint8)
    out[np.arange(out.shape[1])[None] < size[:, None]] = flat
    return out


def by_length(size: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Positions in the order of their lengths, in runs whose matrix is bounded."""
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        room = np.searchsorted(np.maximum(size[order[start:]], 1) * np.arange(1, len(order) - start + 1), cells, "right")
        end = start + max(1, int(room))
        yield order[start:end]
        start = end


# --- edits --------------------------------------------------------------------------------------------------------


#: Cells of the band that are filled together, so that they stay in a core's cache.
BAND = 200_000


def banded(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of rows, exact where at most ``most``, else something larger."""
    n = len(la)
    out = np.full(n, 1 << 14, np.int64)
    if n:
        e = int(most.max())
        step = max(64, BAND // (2 * e + 1))
        for s in range(0, n, step):
            k = slice(s, s + step)
            out[k] = _band(a[k, : int(la[k].max())].T, la[k], b[k].T, lb[k], e)
    return out


def _band(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, e: int) -> np.ndarray:
    """The band around the main diagonal for all pairs, which are columns; cell k of row i is place i + k - e of b."""
    n, width = len(la), 2 * e + 1
    kind, big = (np.int8, 60) if e <= 25 else (np.int16, 1 << 13)
    out = np.full(n, 1 << 14, np.int64)
    pad = np.zeros((2 * e + 1 + b.shape[0] + a.shape[0], n), np.uint8)
    pad[e : e + b.shape[0]] = b
    a = np.ascontiguousarray(a)
    ramp = np.arange(width, dtype=kind)[:, None]
    cur = np.broadcast_to(np.where(ramp >= e, ramp - e, big), (width, n)).astype(kind)
    unlike, t, more = np.empty((width, n), bool), np.empty((width, n), kind), np.empty((width, n), kind)
    done = lb - la
    order = np.argsort(la, kind="stable")
    ends = np.searchsorted(la[order], np.arange(a.shape[0] + 2))
    for i in range(a.shape[0] + 1):
        if i:
            np.not_equal(pad[i - 1 : i - 1 + width], a[i - 1], out=unlike)
            np.add(cur, unlike.view(np.int8), out=t)
            cur += kind(1)
            np.minimum(t[:-1], cur[1:], out=t[:-1])
            if i <= e:
                t[: e - i] = big
                t[e - i] = i
            step = 1
            while step <= e:  # insertions, a step of 1, 2, 4, ... at a time; more than e in a row are too many
                np.add(t[:-step], kind(step), out=more[step:])
                np.minimum(t[step:], more[step:], out=t[step:])
                step *= 2
            np.minimum(t, kind(big), out=cur)
        end = order[ends[i] : ends[i + 1]]
        end = end[np.abs(done[end]) <= e]
        if len(end):
            out[end] = cur[done[end] + e, end]
    return np.where(out >= big, 1 << 14, out)


#: Bits of a text's 3-mers; folding them can only bring two texts nearer.
BITS = 512


def _bits(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """3-mers as ``BITS`` bits a row."""
    out = np.zeros((len(size), BITS), bool)
    if x.shape[1] >= 3:
        y = x.astype(np.uint32)
        g = ((y[:, :-2] * 1024 + y[:, 1:-1] * 32 + y[:, 2:]) * np.uint32(2654435761)) >> np.uint32(23)
        there = np.arange(g.shape[1])[None] <= (size - 3)[:, None]
        # places that hold no 3-mer repeat the row's first one
        out[np.arange(len(size))[:, None], np.where(there, g, g[:, :1])] = True
        out[size < 3] = False
    return np.packbits(out, axis=1).view(np.uint64)


# --- moves --------------------------------------------------------------------------------------------------------


def _exchanged(a: np.ndarray, x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The rows of ``a`` with the blocks of lengths ``p`` and ``q`` from ``x`` on exchanged."""
    cols, w = np.arange(a.shape[1])[None], a.shape[1]
    x, p, q = x[:, None], p[:, None], q[:, None]
    src = np.where((cols < x) | (cols >= x + p + q), cols, np.where(cols < x + q, cols + p, cols - q))
    return np.take_along_axis(a, np.clip(src, 0, w - 1), axis=1)


#: Pairs whose diagonals are counted at a time.
NEAR = 256
#: Distance beyond the bound up to which an exchange is worth shifting, and the shifts of its place and of its two lengths.
SLACK = 8
SHIFTS = np.array([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, -1, 0), (-1, 1, 0), (0, 1, -1), (0, -1, 1), (1, -1, 1), (-1, 1, -1)])


def _moves(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: np.ndarray, diagonals: int, tries: int) -> np.ndarray:
    """Whether exchanging two neighbouring blocks of ``a`` brings it within ``most`` edits of ``b``; a search that finds nearly all.

    The blocks' lengths show as diagonals on which pairs of letters agree,
    above and below the main one; given both, the place is the one at which
    most letters agree. The most promising exchanges are carried out, and
    their three borders shifted as long as the distance falls. Memory grows
    with the texts' length, not its square.
    """
    n, w = a.shape
    if not n or w < 2:
        return np.zeros(n, bool)
    two = lambda z: z[:, :-1].astype(np.uint16) * 256 + z[:, 1:]
    mine = np.where(np.arange(w - 1)[None] < la[:, None] - 1, two(a), 1)
    other = np.full((n, 3 * w), 2, np.uint16)
    other[:, w : w + b.shape[1] - 1] = np.where(np.arange(b.shape[1] - 1)[None] < lb[:, None] - 1, two(b), 2)
    votes = np.zeros((2 * w - 1, n), np.int32)  # diagonal w - 1 is the main one
    wide, count = b.shape[1], np.uint8 if w <= 256 else np.int32
    for s in range(0, n, NEAR):  # rows that stay in a core's cache, as columns
        x, y = np.ascontiguousarray(mine[s : s + NEAR].T), np.ascontiguousarray(other[s : s + NEAR, w : w + wide].T)
        same = np.empty(x.shape, bool)
        for k in range(1, 2 * w - 2):
            first = max(0, w - 1 - k)
            last = max(first, min(w - 1, wide + w - 1 - k))
            part = np.equal(x[first:last], y[first + k + 1 - w : last + k + 1 - w], out=same[: last - first])
            votes[k, s : s + NEAR] = np.add.reduce(part.view(np.uint8), axis=0, dtype=count)
    zero, rows = w - 1, np.arange(n)
    up = np.argsort(-votes[zero + 1 :], axis=0, kind="stable")[:diagonals] + 1
    down = np.argsort(-votes[:zero][::-1], axis=0, kind="stable")[:diagonals] + 1
    around = np.arange(w - 2, 2 * w + 1)[None]

    def agreeing(shift: np.ndarray) -> np.ndarray:
        """Running count of the places that agree on a diagonal or, as an indel within a block shifts it, on its neighbours."""
        near = np.zeros((n, w), bool)
        near_by = np.take_along_axis(other, np.clip(around + shift[:, None], 0, 3 * w - 1), axis=1)
        for s in range(5):
            pair = mine == near_by[:, s : s + w - 1]
            near[:, :-1] |= pair
            near[:, 1:] |= pair
        out = np.zeros((n, w + 1), np.int32)
        np.cumsum(near, axis=1, out=out[:, 1:])
        return out

    head, tail = agreeing(np.zeros(n, np.int64)), agreeing(lb - la)
    tail = tail[:, -1:] - tail
    above, below = [agreeing(u) for u in up], [agreeing(-v) for v in down]
    i1, r = np.arange(w + 1)[None], rows[:, None]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for u, first in zip(up, above, strict=True):  # length of the second block: the first moves right by it
        for v, second in zip(down, below, strict=True):  # length of the first
            i2, i3 = np.minimum(i1 + v[:, None], w), np.minimum(i1 + (u + v)[:, None], w)
            score = head + (first[r, i2] - first) + (second[r, i3] - second[r, i2]) + tail[r, i3]
            score = np.where(i1 + (u + v)[:, None] <= la[:, None], score, -1)
            # of places that are as good, the first and the last
            x0 = score.argmax(axis=1)
            x1 = w - score[:, ::-1].argmax(axis=1)
            found += [(score[rows, x0], x0, v, u), (score[rows, x1], x1, v, u)]
    score = np.stack([f[0] for f in found])
    order = np.argsort(-score, axis=0, kind="stable")[:tries]
    places, ps, qs = (np.stack([f[k] for f in found]) for k in (1, 2, 3))
    best = np.full(n, 1 << 14)
    bx, bp, bq = (np.zeros(n, np.int64) for _ in range(3))

    def test(todo: np.ndarray, x: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """Carries out several exchanges of each pair, one a row, and keeps the best."""
        m = len(x)
        fits = ((x >= 0) & (p > 0) & (q > 0) & (x + p + q <= la[todo])).ravel()
        who = np.tile(todo, m)[fits]
        d = np.full(m * len(todo), 1 << 14)
        d[fits] = banded(_exchanged(a[who], x.ravel()[fits], p.ravel()[fits], q.ravel()[fits]), la[who], b[who], lb[who], most[who] + SLACK)
        d = d.reshape(m, -1)
        k, col = d.argmin(axis=0), np.arange(len(todo))
        less = d[k, col] < best[todo]
        k, col, t = k[less], col[less], todo[less]
        best[t], bx[t], bp[t], bq[t] = d[k, col], x[k, col], p[k, col], q[k, col]

    for run in (order[:1], order[1:]):
        todo = np.nonzero(best > most)[0]
        if len(run) and len(todo):
            test(todo, *(z[run[:, todo], todo] for z in (places, ps, qs)))
    for _ in range(4):
        todo = np.nonzero((best > most) & (best <= most + SLACK))[0]
        if not len(todo):
            break
        before = best[todo].copy()
        test(todo, *(z[todo] + SHIFTS[:, k, None] for k, z in enumerate((bx, bp, bq))))
        if (best[todo] == before).all():
            break
    return best <= most


def lacking(a: str, b: str, most: int) -> int:
    """Disjoint stretches of ``a``, as short as can be, that ``b`` lacks; counted up to ``most`` + 1.

    A near duplicate has an edit or a cut in each of them.
    """
    at = count = 0
    while count <= most:
        low, high = 0, 1
        while at + high <= len(a) and a[at : at + high] in b:
            low, high = high, 2 * high
        high = min(high, len(a) - at + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if a[at : at + mid] in b else (low, mid)
        if at + high > len(a):
            break
        count += 1
        at += high
    return count


def exact_move(a: str, b: str, most: int) -> bool:
    """Whether some exchange of two neighbouring blocks of ``a`` brings it within ``most`` edits of ``b``; all are tried.

    Rows of tables of edit distances are held as bands: after i letters only
    places in b from ``i - most`` to ``i + most`` can be within ``most``
    edits. ``head[x]`` has the distances of the first x letters, ``end[y]``
    those of the letters from y on. For some x at a time, rows for all m go on
    from ``head[x]`` with the letters behind m, and where these can end at y the
    letters from x to m follow. Memory grows with length times ``most``.
    """
    u, v = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (a, b))
    n, w = len(u), len(v)
    if n < 2 or abs(n - w) > most:
        return False
    width, kind = 2 * most + 1, np.int16 if n + w + 4 * most < 30_000 else np.int32
    ramp, big = np.arange(width, dtype=kind), kind(most + 1)

    def windows(text: np.ndarray) -> np.ndarray:
        wide = np.zeros(n + width, np.uint8)
        wide[most : most + w] = text
        return np.lib.stride_tricks.sliding_window_view(wide, width)

    def step(cur: np.ndarray, letter: np.ndarray | int, near: np.ndarray) -> np.ndarray:
        new = np.full(cur.shape, big, kind)
        new[..., :-1] = cur[..., 1:] + kind(1)
        np.minimum(new, cur + (near != letter), out=new)
        return np.minimum.accumulate(new - ramp, axis=-1) + ramp

    def heads(text: np.ndarray, near: np.ndarray) -> np.ndarray:
        out = np.empty((n + 1, width), kind)
        out[0] = np.where(ramp >= most, ramp - kind(most), big)
        for k, c in enumerate(text):
            out[k + 1] = step(out[k], c, near[k])
        return out

    near = windows(v)
    head, back = heads(u, near), heads(u[::-1], windows(v[::-1]))[::-1]
    end = np.full((n + 1, width), big, kind)
    at = w - n + 2 * most - ramp.astype(np.int64)
    inside = (at >= 0) & (at < width)
    end[:, inside] = back[:, at[inside]]
    least = end.min(axis=1)

    def fits(x: np.ndarray, m: np.ndarray, y: np.ndarray, cur: np.ndarray) -> bool:
        """Whether one of the rows, which have read the block from m to y, is within reach after the block from x to m."""
        k = 0
        while len(m):
            done = m == x + k
            if done.any():
                if ((cur[done] + end[y[done]]).min(axis=1) <= most).any():
                    return True
            left = ~done & (cur.min(axis=1) + least[y] <= most)
            x, m, y, cur = x[left], m[left], y[left], cur[left]
            if len(m):
                cur = step(cur, u[x + k][:, None], near[x + y - m + k])
            k += 1
        return False

    # beyond a head that is out of reach all are
    starts = int((np.append(head.min(axis=1), big)[: n - 1] <= most).cumprod().sum())
    together = max(1, CELLS // 4 // (n * width))
    for first in range(0, starts, together):
        x, m = (z.ravel() for z in np.meshgrid(np.arange(first, min(first + together, starts)), np.arange(1, n), indexing="ij"))
        x, m = x[m > x], m[m > x]
        cur = head[x]
        found: list[tuple[np.ndarray, ...]] = []
        held = t = 0
        while len(m):
            cur = step(cur, u[m + t][:, None], near[x + t])
            t += 1
            low = cur.min(axis=1)
            reach = low + least[m + t] <= most
            if reach.any():
                found.append((x[reach], m[reach], m[reach] + t, cur[reach]))
                held += int(reach.sum()) * width
            left = (low <= most) & (m + t < n)
            x, m, cur = x[left], m[left], cur[left]
            if found and (held > CELLS // 4 or not len(m)):
                if fits(*(np.concatenate(z) for z in zip(*found, strict=True))):
                    return True
                found, held = [], 0
    return False


# --- pairs --------------------------------------------------------------------------------------------------------


def verify(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Which pairs of texts are near duplicates, of whatever length."""
    out = np.zeros(len(a), bool)
    # a text is in several pairs
    code, texts = pd.factorize(pd.concat([a, b], ignore_index=True).to_numpy(object))
    i, j = code[: len(a)], code[len(a) :]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for run in by_length(np.maximum(sizes[i], sizes[j])):
        out[run] = _verify(texts, i[run], j[run])
    return out


def _verify(texts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), bool)
    mine, code = np.unique(np.concatenate([i, j]), return_inverse=True)
    each, sizes = encode(texts[mine])
    i, j = code[: len(i)], code[len(i) :]
    la, lb = sizes[i], sizes[j]
    most = budget(np.maximum(la, lb))
    bits = _bits(each, sizes)
    # an edit changes at most 3 3-mers on either side, a cut 2
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
    todo = np.nonzero((apart <= 6 * most + 4 * CUTS) & (np.abs(la - lb) <= most))[0]
    i, j, la, lb, most = (z[todo] for z in (i, j, la, lb, most))
    ok = banded(each[i], la, each[j], lb, most) <= most
    step = max(1, CELLS // (8 * max(1, each.shape[1])))

    def search(open_: np.ndarray, diagonals: int, tries: int, both: bool) -> np.ndarray:
        for one, two, lone, ltwo in ((i, j, la, lb), (j, i, lb, la))[: 1 + both]:
            for s in range(0, len(open_), step):
                k = open_[s : s + step]
                ok[k] = _moves(each[one[k]], lone[k], each[two[k]], ltwo[k], most[k], diagonals, tries)
            open_ = open_[~ok[open_]]
        return open_

    # the other way round finds few more: that is left to the wider search
    rest = search(np.nonzero(~ok)[0], 1, 2, False)
    pairs = [(k, texts[mine[i[k]]], texts[mine[j[k]]], int(most[k])) for k in rest]
    pairs = [(k, x, y, e) for k, x, y, e in pairs if lacking(x, y, e + CUTS) <= e + CUTS and lacking(y, x, e + CUTS) <= e + CUTS]
    rest = set(search(np.array([k for k, *_ in pairs], np.int64), 7, 12, True).tolist())
    for k, x, y, e in pairs:
        if k in rest:
            ok[k] = exact_move(x, y, e)
    out[todo] = ok
    return out
