"""Kernel of the exact top-k: rows of a shard in small blocks of alike rows,
with inverted lists of block maxima.

Per bucket (vector component) the shard keeps one list: the largest unit
component of every block (and the smallest, where components are negative). A
query adds up the lists of its own buckets, which bounds the cosine it can
reach in each block. The blocks with the highest bounds are scored first and
give a first k-th score; after that the query meets only blocks whose bound
reaches it. Equal scores stay in, so ties are exact.

Bounds and first scores are products of unit vectors in float32, lowered by
more than their rounding (``Shard.slack``). Only pairs that reach the query's
k-th score so far are scored in float64; those scores decide.

Where the bounds leave most blocks (WIDE), as in dense vectors, gathering the
blocks costs more than it saves: the shard's further tiles of queries meet all
rows as they lie, against a first k-th score from rows spread over the shard,
and are not bounded again.

Count vectors (integers, none negative) are met five or six in one then
(:class:`Packed`): a product tells which of its rows reach the query's k-th
score so far, and only those are scored. Dot products that are too large for
that are met two in one, where they come out exact.

Products go to one buffer that stays (a new one for every tile costs as much
as part of the product, in fresh pages).

Memory: the shard, one tile of scores and HELD candidates per tile of queries.
"""
from __future__ import annotations

import numpy as np

BLOCK_ROWS = 16
PIVOTS = 256
TILE_QUERIES, TILE_ROWS = 512, 2048
ALIKE_ROWS = 4096                # made into unit vectors, and ordered, at once
SEED_BLOCKS = 4                  # scored first, besides those that k rows need
WIDE = 0.5                       # share of blocks met from which all rows are met as they lie
SPREAD_ROWS = 4096               # of the shard that give the first k-th score then
HELD = 1 << 18                   # candidates of a tile before only the best are kept
EXACT_ROWS = 1 << 14             # pairs scored in float64 at once
PACKED_QUERIES, PACKED_ROWS = 2048, 2048     # queries and rows of a part that are met packed
MET_QUERIES = 512                # of them in one product, whose results stay in a core's cache
LIKE = 1.25                      # squared norms of a part's rows differ by this factor at most
SAMPLED = 8                      # parts, about, that give the first k-th score,
TOPS = 4                         # with the best rows of so many groups of either half
FIELD = 12                       # bits of the first row's dot product, at least one more than it needs
WHOLE = 1 << 23                  # a float32 from here to twice this has an integer's bits as its lowest
BASE = int(np.float32(WHOLE).view(np.int32))
FLAGGED = ((6, 8), (5, 10))      # rows met in one float64, and bits of each one's field
WHOLE_64 = 1 << 52               # a float64 from here to twice this has an integer's bits as its lowest
STRETCHES = 4                    # of a query's results, looked at for themselves
FIT = 0.95                       # share of the queries that must fit the narrower fields


def scores(qm: np.ndarray, qn: np.ndarray, cm: np.ndarray, cn: np.ndarray) -> np.ndarray:
    """Cosines of one tile; ``qn``, ``cn``: squared norms."""
    dots = qm @ cm.T
    for i in range(len(qm)):                 # row by row: no second matrix of the tile's size
        den = np.sqrt(qn[i] * cn)
        np.divide(dots[i], den, out=dots[i], where=den > 0)
        dots[i][den <= 0] = 0.0
    return dots


def _exact(q: np.ndarray, qn: np.ndarray, c: np.ndarray, cn: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each added up in the same order."""
    den = np.sqrt(qn * cn)
    return np.divide(np.einsum("ij,ij->i", q, c), den, out=np.zeros(len(q)), where=den > 0)


def _cells(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true cells, found eight at a time."""
    flat = mask.reshape(-1)
    whole = len(flat) - len(flat) % 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _unit(m: np.ndarray, sq: np.ndarray) -> np.ndarray:
    return m * np.divide(1.0, np.sqrt(sq), out=np.zeros(len(m)), where=sq > 0)[:, None]


def _tiles(m: np.ndarray):
    return (m[lo:lo + ALIKE_ROWS] for lo in range(0, len(m), ALIKE_ROWS))


def _best_first(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best candidates: by query, then falling
    score, then id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - first < k]


def _alike(unit: np.ndarray) -> np.ndarray:
    """An order of the rows with alike ones side by side: by the nearest of some
    of the rows, then by the buckets that stand out most."""
    top = min(2, unit.shape[1])
    scale = np.sqrt(np.mean([np.abs(part).mean(axis=0) for part in _tiles(unit)], axis=0) + 1e-12)
    pivots = unit[np.linspace(0, len(unit) - 1, min(PIVOTS, max(1, len(unit) // BLOCK_ROWS))).astype(int)]
    leads, near = [], []
    for part in _tiles(unit):
        weight = np.abs(part) / scale
        lead = np.argpartition(-weight, top - 1, axis=1)[:, :top]
        leads.append(np.take_along_axis(lead, np.argsort(-np.take_along_axis(weight, lead, 1), axis=1, kind="stable"), 1))
        near.append((part @ pivots.T).argmax(axis=1))
    return np.lexsort((*np.concatenate(leads).T[::-1], np.concatenate(near)))


class Packed:
    """Rows of counts two in one, ``a + 4096 b``: a product with a query's
    counts is the sum of both dot products, exact in float32 while each is
    below 2048. A constant column adds WHOLE, so that the bits of the sum are
    both results side by side. Rows of a part have like norms, so one limit a
    query decides for all of them."""

    def __init__(self, m: np.ndarray, sq: np.ndarray):
        order = np.argsort(sq, kind="stable")
        grown, lo = sq[order], 0
        self.parts = []                                  # rows, packed rows, least and greatest squared norm
        while lo < len(m):
            hi = min(lo + PACKED_ROWS, int(np.searchsorted(grown, grown[lo] * LIKE, "right")))
            rows, lo = order[lo:hi], hi
            half = (len(rows) + 1) // 2
            two = np.full((half, m.shape[1] + 1), WHOLE, np.float32)
            two[:, :-1] = m[rows[:half]]
            two[:len(rows) - half, :-1] += m[rows[half:]].astype(np.float32) * (1 << FIELD)
            self.parts.append((rows, two, sq[rows[0]], sq[rows[-1]]))
        self.m, self.sq, self.many = m, sq, {}                        # part -> rows in one, bits of a field, packed rows
        self.products, self.firsts, self.sums = np.empty(0, np.float32), np.empty(0, np.int32), np.empty(0)

    @staticmethod
    def queries(q: np.ndarray) -> np.ndarray | None:
        """Queries for :meth:`reaching`, or None if they are no counts."""
        if (q < 0).any() or (q != np.floor(q)).any():
            return None
        return np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(np.float32)

    @staticmethod
    def fits(qn: np.ndarray, high: float) -> np.ndarray:
        """Queries whose dot products with a part's rows are below 2048."""
        return qn * high < ((1 << FIELD - 1) - 1) ** 2

    def _dots(self, q: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dot products with the first rows; and the bits of the sums, BASE and
        4096 times those with the second rows above them. Until the next
        product."""
        size = len(q) * len(two)
        if size > len(self.products):
            self.products, self.firsts = np.empty(size, np.float32), np.empty(size, np.int32)
        sums = np.matmul(q, two.T, out=self.products[:size].reshape(len(q), len(two))).view(np.int32)
        return np.bitwise_and(sums, (1 << FIELD) - 1, out=self.firsts[:size].reshape(sums.shape)), sums

    def first_kth(self, q: np.ndarray, qn: np.ndarray, k: int) -> np.ndarray:
        """A k-th score that each query surely reaches, from some of the
        parts: k groups of their rows hold k rows."""
        tops, each = [], max(3, len(self.parts) // SAMPLED)
        for _, two, _, high in self.parts[each // 2::each]:
            ok, per = self.fits(qn, high), np.sqrt(qn * high)
            first, sums = self._dots(q, two)
            for dots in (first, sums):
                for lo in range(0, len(two), step := -(-len(two) // TOPS)):
                    top = dots[:, lo:lo + step].max(axis=1)
                    tops.append(np.divide(top if dots is first else top - BASE >> FIELD, per, out=np.zeros(len(q)), where=ok & (per > 0)))
        if len(tops) < k:
            return np.full(len(q), -np.inf)
        return np.partition(np.array(tops), -k, axis=0)[-k]

    def reaching(self, q: np.ndarray, limit: np.ndarray, rows: np.ndarray, two: np.ndarray):
        """(query, row, dot product) of the pairs at or above each query's limit."""
        half, found = len(two), []
        first, sums = self._dots(q, two)
        for dots, least, n, at in ((first, limit, half, 0), (sums, BASE + (limit << FIELD), len(rows) - half, half)):
            some = np.flatnonzero(dots.max(axis=1) >= least)     # few, once the k-th scores are high
            i, j = np.divmod(_cells(dots[some] >= least[some, None]), half)
            if n < half:                                 # the last row has no second one beside it
                i, j = i[j < n], j[j < n]
            i = some[i]
            d = dots[i, j]
            found.append((i, rows[at + j], d if dots is first else d - BASE >> FIELD))
        return (np.concatenate(x) for x in zip(*found))


    @staticmethod
    def flags(most: np.ndarray, limits: np.ndarray, bits: int) -> np.ndarray:
        """Queries whose dot products, at most ``most``, stay in fields of so
        many bits with the highest one set from the limits on, which grow from
        field to field."""
        half = 1 << bits - 1
        return (limits[:, -1] <= half) & (most < limits[:, 0] + half)

    def limits(self, at: int, n: int, root: np.ndarray, positive: np.ndarray) -> tuple[int, np.ndarray]:
        """Rows of a part in each of ``n`` fields, and the least dot product
        of each query that reaches its k-th score there: ``root`` times the
        field's least norm, and one where that score is ``positive``."""
        rows = self.parts[at][0]
        width = -(-len(rows) // (n * STRETCHES)) * STRETCHES
        least = np.sqrt(self.sq[rows[np.minimum(np.arange(n) * width, len(rows) - 1)]])
        return width, np.maximum(np.ceil(np.multiply.outer(root, least)), positive[:, None])

    def flagged(self, at: int, most: np.ndarray, root: np.ndarray, positive: np.ndarray):
        """(rows in one, bits of a field, packed rows), (limits, queries that
        fit) of a part, in the narrowest fields that most queries fit."""
        n, bits, packed = self.many.get(at, (*FLAGGED[0], None))
        width, limits = self.limits(at, n, root, positive)
        flags = Packed.flags(most, limits, bits)
        if (n, bits) != FLAGGED[-1] and flags.mean() < FIT:
            (n, bits), packed = FLAGGED[-1], None
            width, limits = self.limits(at, n, root, positive)
            flags = Packed.flags(most, limits, bits)
        if packed is None:
            rows = self.parts[at][0]
            packed = np.zeros((width, self.m.shape[1] + 1))
            packed[:, -1] = 1
            for f in range(n):
                some = rows[f * width:(f + 1) * width]
                packed[:len(some), :-1] += self.m[some] * float(1 << f * bits)
            self.many[at] = n, bits, packed
        return (n, bits, packed), (limits, flags)

    def meeting(self, q: np.ndarray, limits: np.ndarray, flags: np.ndarray, rows: np.ndarray, n: int, bits: int, packed: np.ndarray):
        """(query, row) of the pairs at or above each query's limits, without
        queries that do not fit (:meth:`flags`). ``q`` has a last column, which
        is overwritten."""
        half, ones = 1 << bits - 1, [1 << f * bits for f in range(n)]
        marks = (np.arange(1, n + 1) * bits - 1)[:, None]
        high, size = sum(ones) * half, MET_QUERIES * len(packed)
        if size > len(self.sums):
            self.sums = np.empty(size)
        q[:, -1] = WHOLE_64 + (half - limits) @ np.array(ones, float)
        for lo in range(0, len(q), MET_QUERIES):
            part = q[lo:lo + MET_QUERIES]
            sums = np.matmul(part, packed.T, out=self.sums[:len(part) * len(packed)].reshape(len(part), -1))
            sums = sums.view(np.int64).reshape(len(part) * STRETCHES, -1)
            some = np.flatnonzero(np.bitwise_or.reduce(sums, axis=1) & high)
            some = some[flags[lo + some // STRETCHES]]
            i, j = np.divmod(_cells((sums[some] & high) != 0), sums.shape[1])
            some = some[i]
            cell, i, j = sums[some, j], some // STRETCHES + lo, some % STRETCHES * sums.shape[1] + j
            f, on = np.nonzero(cell >> marks & 1)
            i, at = i[on], f * len(packed) + j[on]
            real = at < len(rows)
            yield i[real], rows[at[real]]


class Shard:
    """Corpus rows with their blocks and inverted lists. ``met`` and ``pairs``
    count the (query, block) pairs that were scored, and all there were."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, block_rows: int = BLOCK_ROWS):
        if m.dtype.kind == "f":
            whole = np.isfinite(m).all(axis=1)           # others have no score
            if not whole.all():
                ids, m = ids[whole], m[whole]
        sq, unit = np.zeros(len(m)), np.zeros(m.shape, np.float32)
        for lo in range(0, len(m), ALIKE_ROWS):          # rows stay in their own type, and are float64 a tile at a time
            part = m[lo:lo + ALIKE_ROWS].astype(np.float64)
            sq[lo:lo + ALIKE_ROWS] = np.einsum("ij,ij->i", part, part)
            unit[lo:lo + ALIKE_ROWS] = _unit(part, sq[lo:lo + ALIKE_ROWS])
        if len(m):
            order = _alike(unit)
            ids, m, sq, unit = ids[order], m[order], sq[order], unit[order]
        self.ids, self.m, self.sq, self.block_rows = ids, m, sq, block_rows
        at = np.arange(0, len(m), block_rows)
        self.slack = (m.shape[1] + 4) * 2.0 ** -22      # above the rounding of a float32 product with a block's maxima
        self.high = np.ascontiguousarray(np.maximum.reduceat(unit, at, axis=0).T) if len(m) else np.zeros((0, 0))
        self.low = np.ascontiguousarray(np.minimum.reduceat(unit, at, axis=0).T) if len(m) and (m < 0).any() else None
        self.unit, self.met, self.pairs, self.wide = unit, 0, 0, False
        self.products = np.empty(0, np.float32)
        self.spread = np.ascontiguousarray(unit[::max(1, len(unit) // SPREAD_ROWS)]) if len(m) else unit
        self.counts, self.packed = m.dtype.kind in "iu" and self.low is None, None

    @property
    def tile(self) -> int:
        """Queries that are best searched at once."""
        return PACKED_QUERIES if self.wide and self.counts else TILE_QUERIES

    def _rows(self, blocks: np.ndarray) -> np.ndarray:
        rows = (blocks[:, None] * self.block_rows + np.arange(self.block_rows)).reshape(-1)
        return rows[rows < len(self.ids)]

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Highest cosine that each query can reach in each block."""
        own = np.flatnonzero(unit.any(axis=0))           # only the lists of the queries' buckets are read
        q = unit[:, own]
        if self.low is None and not (q < 0).any():
            return q @ self.high[own]
        low = self.low if self.low is not None else np.zeros_like(self.high)
        return np.maximum(q, 0) @ self.high[own] + np.minimum(q, 0) @ low[own]

    def _first_kth(self, unit: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """A k-th score that each query surely reaches."""
        take = -(-k // self.block_rows) + SEED_BLOCKS
        if bound.shape[1] <= 2 * take or len(self.ids) < k + self.block_rows:
            return np.full(len(unit), -np.inf)
        blocks = np.argpartition(-bound, take - 1, axis=1)[:, :take]
        rows = (blocks[:, :, None] * self.block_rows + np.arange(self.block_rows)).reshape(len(unit), -1)
        s = np.matmul(self.unit[np.minimum(rows, len(self.ids) - 1)], unit[:, :, None])[:, :, 0]
        s[rows >= len(self.ids)] = -np.inf
        return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]

    def _spread_kth(self, unit: np.ndarray, k: int) -> np.ndarray:
        """A k-th score that each query surely reaches, from rows spread over
        the shard: k groups of them hold k rows."""
        groups = np.arange(0, len(self.spread), self.block_rows)
        if len(groups) <= k:
            return np.full(len(unit), -np.inf)
        tops = np.maximum.reduceat(unit @ self.spread.T, groups, axis=1)
        return np.partition(tops, -k, axis=1)[:, -k]

    def _products(self, unit: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """``unit @ rows.T`` in the buffer, until the next product."""
        size = len(unit) * len(rows)
        if size > len(self.products):
            self.products = np.empty(size, np.float32)
        return np.matmul(unit, rows.T, out=self.products[:size].reshape(len(unit), len(rows)))

    def _near(self, unit: np.ndarray, k: int, floor: np.ndarray, reach: np.ndarray, known: bool = False):
        """Per part of the rows: (queries that ask for it, its rows, their
        scores in float32, which the next part overwrites). ``reach``, which
        the caller raises, is filled before the first part."""
        step = max(1, TILE_ROWS // self.block_rows)
        if self.wide:
            reach[:] = (floor if known else np.maximum(self._spread_kth(unit, k), floor)) - self.slack
            n = -(-len(self.ids) // self.block_rows)
            self.met += n * len(unit)
            self.pairs += n * len(unit)
            every = np.arange(len(unit))
            for lo in range(0, len(self.ids), step * self.block_rows):
                hi = min(lo + step * self.block_rows, len(self.ids))
                yield every, np.arange(lo, hi), self._products(unit, self.unit[lo:hi])
            return
        bound = self.bounds(unit)
        reach[:] = np.maximum(self._first_kth(unit, bound, k) - self.slack, floor - self.slack)
        meets = bound >= reach[:, None] - self.slack
        self.met += int(meets.sum())
        self.pairs += meets.size
        self.wide = meets.mean() >= WIDE
        blocks = np.flatnonzero(meets.any(axis=0))
        blocks = blocks[np.argsort(-bound.max(axis=0)[blocks], kind="stable")]
        bound = np.take(bound, blocks, axis=1)
        for lo in range(0, len(blocks), step):
            part = blocks[lo:lo + step]
            asks = np.flatnonzero(bound[:, lo:lo + step].max(axis=1) >= reach - self.slack)
            rows = self._rows(part)
            near = self._products(unit[asks], self.unit[rows])
            if lo == 0 and len(part) > k:        # k blocks hold k rows
                tops = np.maximum.reduceat(near, np.arange(0, len(rows), self.block_rows), axis=1)
                reach[asks] = np.maximum(reach[asks], np.partition(tops, -k, axis=1)[:, -k] - self.slack)
            yield asks, rows, near

    def _scored(self, q: np.ndarray, qn: np.ndarray, unit: np.ndarray, asks: np.ndarray, rows: np.ndarray, near: np.ndarray,
                reach: np.ndarray):
        """(query, row, score) of the pairs of a part that reach the k-th
        scores, by their float32 scores ``near``."""
        limit = (reach[asks] - self.slack).astype(np.float32)
        some = np.flatnonzero(near.max(axis=1) >= limit)         # few, once the k-th scores are high
        asks, cells = asks[some], _cells(near[some] >= limit[some, None])
        for at in range(0, len(cells), EXACT_ROWS):
            i, j = np.divmod(cells[at:at + EXACT_ROWS], len(rows))
            i, j = asks[i], rows[j]
            yield i, j, _exact(q[i], qn[i], self.m[j].astype(np.float64), self.sq[j])

    def _exactly(self, q: np.ndarray, qn: np.ndarray, pairs: list, reach: np.ndarray):
        """(query, row, score) of those of some (queries, rows) that reach the
        k-th scores."""
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        for lo in range(0, len(i), EXACT_ROWS):
            a, b = i[lo:lo + EXACT_ROWS], j[lo:lo + EXACT_ROWS]
            s = _exact(q[a], qn[a], self.m[b].astype(np.float64), self.sq[b])
            near = s >= reach[a]
            yield a[near], b[near], s[near]

    def _candidates(self, q: np.ndarray, qn: np.ndarray, unit: np.ndarray, k: int, floor: np.ndarray, reach: np.ndarray, known: bool):
        """(query, row, score) of all pairs that reach the k-th scores so far."""
        counts = Packed.queries(q) if self.wide and self.counts else None
        if counts is None:
            for part in self._near(unit, k, floor, reach, known):
                yield from self._scored(q, qn, unit, *part, reach)
            return
        if self.packed is None:
            self.packed = Packed(self.m, self.sq)
        n = -(-len(self.ids) // self.block_rows)
        self.met += n * len(q)
        self.pairs += n * len(q)
        reach[:] = floor
        for lo in range(0, len(q) if not known else 0, MET_QUERIES):
            part = slice(lo, lo + MET_QUERIES)
            reach[part] = np.maximum(self.packed.first_kth(counts[part], qn[part], k), floor[part])
        reach -= self.slack
        doubles, pairs, waiting = np.concatenate([q, np.ones((len(q), 1))], axis=1), [], 0
        for at, (rows, two, low, high) in enumerate(self.packed.parts):
            root = np.maximum(reach, 0.0) * np.sqrt(qn) * (1 - 2.0 ** -40)
            fields, (limits, flags) = self.packed.flagged(at, np.sqrt(qn * high) * (1 + 2.0 ** -40), root, reach > 0)
            if flags.any():
                few = np.flatnonzero(flags) if flags.mean() < FIT / 2 else None      # else cheaper met than left out
                asked = (doubles, limits, flags) if few is None else (doubles[few], limits[few], flags[few])
                for i, j in self.packed.meeting(*asked, rows, *fields):
                    pairs.append((i if few is None else few[i], j))
                    waiting += len(j)
                if waiting >= EXACT_ROWS:
                    yield from self._exactly(q, qn, pairs, reach)
                    pairs, waiting = [], 0
            fits = ~flags & Packed.fits(qn, high)
            asks = np.flatnonzero(fits)
            if len(asks):
                i, j, d = self.packed.reaching(counts[asks], limits[asks, 0].astype(np.int32), rows, two)
                i = asks[i]
                den = np.sqrt(qn[i] * self.sq[j])
                s = np.divide(d, den, out=np.zeros(len(d)), where=den > 0)
                near = s >= reach[i]
                yield i[near], j[near], s[near]
            asks = np.flatnonzero(~flags & ~fits)
            if len(asks):
                yield from self._scored(q, qn, unit, asks, rows, self._products(unit[asks], self.unit[rows]), reach)
        yield from self._exactly(q, qn, pairs, reach)

    def search(self, q: np.ndarray, k: int, floor: float | np.ndarray = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows of every query, without rows
        below ``floor``, or below each query's own, which is near its k-th
        score then."""
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if not len(self.ids) or not len(q):
            return tuple(out)
        q = q.astype(np.float64, copy=False)
        qn = np.einsum("ij,ij->i", q, q)
        unit = _unit(q, qn).astype(np.float32)
        known, floor = np.ndim(floor) > 0, np.broadcast_to(np.asarray(floor, float), len(q))
        held, size, last, reach = [out], 0, 0, np.zeros(len(q))

        def best():
            cols = [np.concatenate([h[i] for h in held]) for i in range(3)]
            top = _best_first(*cols, k)
            return [c[top] for c in cols]

        for i, j, s in self._candidates(q, qn, unit, k, floor, reach, known):
            kept = s >= floor[i]
            held.append([i[kept], self.ids[j[kept]], s[kept]])
            size += len(held[-1][0])
            if size > HELD or size > 2 * last:
                held = [best()]
                size = last = len(held[0][0])
                full = np.bincount(held[0][0], minlength=len(q)) == k
                kth = np.full(len(q), np.inf)
                np.minimum.at(kth, held[0][0], held[0][2])
                reach[:] = np.where(full, np.maximum(reach, kth - self.slack), reach)
        return tuple(best())
