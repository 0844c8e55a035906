"""The context tree in one process, for small tables: the operator's tables are
held against it."""

from __future__ import annotations

import math

import numpy as np


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series behind a shift of eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    out = np.zeros(zeros.shape)
    seen = zeros + ones > 0   # most nodes of a context have no byte at all
    z, o = zeros[seen], ones[seen]
    out[seen] = _log_gamma(z + 0.5) + _log_gamma(o + 0.5) - _log_gamma(z + o + 1) - math.log(math.pi)
    return out


def _bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte counts [contexts, 256] -> zeros and ones at the 255 nodes of the bit
    tree (node 1 first, the highest bit)."""
    zeros, ones = [], []
    for k in range(8):
        halves = counts.reshape(len(counts), 1 << k, 2, 1 << (7 - k)).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


CHUNK = 1024  # contexts whose 255 nodes are worked on at a time


class ContextTree:
    """The same tree in one process, for small tables: contexts[d]: sorted contexts of depth d; place[d]: their first row in
    ``table`` [rows, 256], the log10 probability of each byte behind them."""

    def __init__(self, contexts: list[np.ndarray], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """contexts[d] sorted, every context's parent is there; counts[d]: (row
        of the context, byte, times seen), in order of the rows. Counts stay
        sparse; only CHUNK contexts at a time are laid out."""
        depth = len(contexts) - 1
        parents = [np.searchsorted(contexts[d - 1], contexts[d] & np.uint64((1 << 8 * (d - 1)) - 1)) if d else None
                   for d in range(depth + 1)]
        rest = []   # what the children left out have: the counts less those of the children
        for d in range(depth + 1):
            row, byte, n = counts[d]
            if d < depth:
                below = counts[d + 1]
                row, byte, n = (np.concatenate(x) for x in ((row, parents[d + 1][below[0]]), (byte, below[1]), (n, -below[2])))
                order = np.argsort(row, kind="stable")
                row, byte, n = row[order], byte[order], n[order]
            rest.append((row, byte, n))

        def nodes(sparse, lo: int, hi: int):
            row, byte, n = sparse
            a, b = np.searchsorted(row, [lo, hi])
            dense = np.zeros((hi - lo, 256))
            np.add.at(dense, (row[a:b] - lo, byte[a:b]), n[a:b])
            return _bit_counts(dense)

        def share(z, o):
            return (o + 0.5) / (z + o + 1)

        def chunks(d):
            return [(lo, min(lo + CHUNK, len(contexts[d]))) for lo in range(0, len(contexts[d]), CHUNK)]

        half = math.log(0.5)
        weight: list = [None] * (depth + 1)
        children = None   # by context of this depth: log weighted probability of its kept children
        for d in range(depth, -1, -1):
            above = np.zeros((len(contexts[d - 1]), 255)) if d else None
            weight[d] = np.ones((len(contexts[d]), 255), np.float32)
            for lo, hi in chunks(d):
                own = _log_kt(*nodes(counts[d], lo, hi))
                weighted = own
                if d < depth:
                    weighted = np.logaddexp(half + own, half + _log_kt(*nodes(rest[d], lo, hi)) + children[lo:hi])
                    weight[d][lo:hi] = np.exp(half + own - weighted)
                if d:
                    np.add.at(above, parents[d][lo:hi], weighted)
            children = above
        tables = []
        mixed = left = None
        for d in range(depth + 1):
            m, r = np.zeros((len(contexts[d]), 255)), np.ones((len(contexts[d]), 255))
            if d:
                m, r = mixed[parents[d]], left[parents[d]]
            table = np.zeros((len(contexts[d]), 256), np.float32)
            for lo, hi in chunks(d):
                m[lo:hi] += r[lo:hi] * weight[d][lo:hi] * share(*nodes(counts[d], lo, hi))
                r[lo:hi] *= 1 - weight[d][lo:hi]
                table[lo:hi] = self._bytes(m[lo:hi] + r[lo:hi] * share(*nodes(rest[d], lo, hi)))
            mixed, left = m, r
            tables.append(table)
        self.contexts = contexts
        self.place = np.cumsum([0] + [len(c) for c in contexts])
        self.table = np.concatenate(tables)

    @staticmethod
    def _bytes(p: np.ndarray) -> np.ndarray:
        """P(one) at the 255 nodes -> log10 probability of the 256 bytes."""
        out, node = np.zeros((len(p), 1)), 0
        for k in range(8):
            q = np.clip(p[:, node:node + (1 << k)], 1e-12, 1 - 1e-12)
            node += 1 << k
            out = np.stack([out + np.log10(1 - q), out + np.log10(q)], axis=2).reshape(len(p), 2 << k)
        return out

    def rows(self, context: np.ndarray) -> np.ndarray:
        """The table row of the longest known context of each place."""
        row = np.zeros(len(context), np.int64)
        open_ = np.arange(len(context))
        for d in range(len(self.contexts) - 1, 0, -1):
            known = self.contexts[d]
            if not len(known):
                continue
            c = context[open_] & np.uint64((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(known, c), len(known) - 1)
            hit = known[at] == c
            row[open_[hit]] = self.place[d] + at[hit]
            open_ = open_[~hit]
        return row
