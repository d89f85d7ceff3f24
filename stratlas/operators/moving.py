"""The passes of ``graph.many_communities`` over one graph that lies in one task, as arrays; same moves, same order, same stops."""

from __future__ import annotations

import zlib

import numpy as np

#: A pair of nodes in a block: ends a <= b, weight, and bits (1, 2: the ends' turn; 4, 8: the ends are among the nodes asked for).
PAIR = [("a", np.int64), ("b", np.int64), ("weight", np.float64), ("bits", np.uint8)]


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Pairs as compressed columns, one after another."""
    return zlib.compress(b"".join(np.ascontiguousarray(columns[name], kind).tobytes() for name, kind in PAIR), 1)


def unpack(block: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(block), 0, []
    n = len(raw) // sum(np.dtype(kind).itemsize for _, kind in PAIR)
    for _, kind in PAIR:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out

SLICE = 1 << 18  # entries that a pass takes at once, or those of one node


class Graph:
    """Pairs of one graph by node number (in order of ids), the nodes' turns, and which of them are asked for."""

    def __init__(self, blocks: list[bytes]):
        parts = [unpack(b) for b in blocks]
        blocks.clear()
        a, b, self.weight, bits = (np.concatenate([p[i] for p in parts]) for i in range(len(PAIR)))
        del parts
        self.ids = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
        self.a, self.b = np.searchsorted(self.ids, a).astype(np.int32), np.searchsorted(self.ids, b).astype(np.int32)
        self.turn, self.known = np.zeros(len(self.ids), np.uint8), np.zeros(len(self.ids), bool)
        for end, shift in ((self.a, 0), (self.b, 1)):
            self.turn[end], self.known[end] = bits >> shift & 1, bits >> (2 + shift) & 1


def communities(g: Graph, m2: float, resolution: float, levels: int, passes: int | None, best: float | None = None) -> np.ndarray:
    """A node number for each node: the smallest of its community. ``best``: the modularity that the first level has to exceed."""
    label_of = np.arange(len(g.ids), dtype=np.int32)
    if not np.isfinite(m2):  # no gain is a number
        return label_of
    a, b, weight, turn, names = g.a, g.b, g.weight, g.turn, label_of
    for _ in range(levels):
        kept, score = _level(a, b, weight, turn, m2, resolution, passes)
        low = np.full(len(kept), len(kept), np.int32)
        np.minimum.at(low, kept, np.arange(len(kept), dtype=np.int32))
        heads, fresh = np.unique(low[kept], return_inverse=True)  # the next level's nodes, each named by its smallest member
        label_of, names, turn = fresh.astype(np.int32)[label_of], names[heads], turn[heads]
        if best is not None and not score > best + 1e-7:
            break
        best = score
        a, b, weight = _folded(fresh[a], fresh[b], weight, a == b, len(heads))
    return names[label_of]


def _folded(a: np.ndarray, b: np.ndarray, weight: np.ndarray, loops: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of communities; a pair inside one counts from both ends, a loop already does."""
    key = np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b)
    weight = np.where((a == b) & ~loops, 2 * weight, weight)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = key[first]
    return (ends // n).astype(np.int32), (ends % n).astype(np.int32), np.add.reduceat(weight[order], first)


def _level(a: np.ndarray, b: np.ndarray, weight: np.ndarray, turn: np.ndarray, m2: float, resolution: float, passes: int | None) -> tuple[np.ndarray, float]:
    """The best labels that the passes of a level meet, and their modularity."""
    n, loop = len(turn), a == b
    penalty = resolution / m2
    k = np.bincount(a, weight, n) + np.bincount(b[~loop], weight[~loop], n)
    apart = np.flatnonzero(~loop)
    halves = []
    for half in (0, 1):  # the neighbours of the nodes that move in even and in odd passes, grouped by node
        there, back = apart[turn[a[apart]] == half], apart[turn[b[apart]] == half]
        src = np.concatenate([a[there], b[back]])
        order = np.argsort(src, kind="stable")
        src, dst, w = src[order], np.concatenate([b[there], a[back]])[order], np.concatenate([weight[there], weight[back]])[order]
        cuts = np.searchsorted(src, np.unique(src[::SLICE])).tolist()
        halves.append([(src[i:j], dst[i:j], w[i:j]) for i, j in zip(cuts, [*cuts[1:], len(src)])])

    def modularity(label, total):
        return float(2 * weight[label[a] == label[b]].sum() - weight[loop].sum()) / m2 - resolution * float((total * total).sum()) / m2**2

    label = np.arange(n, dtype=np.int32)
    total = np.bincount(label, k, n)
    kept, score, at = label, modularity(label, total), 0
    while at != passes:
        before, label = label, label.copy()
        for src, dst, w in halves[at % 2]:
            key = src.astype(np.int64) * n + before[dst]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, inner = key[first], np.add.reduceat(w[order], first)
            node, to = key // n, key % n
            own = to == before[node]
            gain = inner - penalty * k[node] * (total[to] - np.where(own, k[node], 0.0))
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[start, len(node)])
            mover = node[start]
            stay = -penalty * k[mover] * (total[before[mover]] - k[mover])
            stay[np.repeat(np.arange(len(start)), size)[own]] = gain[own]
            rounded = np.round(gain, 9)
            hits = np.flatnonzero(rounded == np.repeat(np.maximum.reduceat(rounded, start), size))
            hits = hits[np.r_[True, node[hits[1:]] != node[hits[:-1]]]]  # labels rise within a node, so the first is the smallest
            go = np.maximum.reduceat(gain, start) > stay + 1e-7
            label[mover[go]] = to[hits][go]
        total = np.bincount(label, k, n)
        now = modularity(label, total)
        if now > score + 1e-7:
            kept, score = label, now
        elif at % 2:
            break
        at += 1
    return kept, score


def tally(g: Graph, label: np.ndarray, m2: float, resolution: float) -> dict[str, float | int | None]:
    """Of the nodes asked for: how many have pairs, their communities and the largest; the modularity of the pairs between them."""
    sizes = np.bincount(label[g.known], minlength=1)
    apart = (g.a != g.b) & g.known[g.a] & g.known[g.b]
    a, b, w = label[g.a[apart]], label[g.b[apart]], g.weight[apart]
    degree, whole = np.bincount(a, w, len(label)) + np.bincount(b, w, len(label)), 2 * float(w.sum())
    score = 2 * float(w[a == b].sum()) / whole - resolution * float((degree * degree).sum()) / whole**2 if whole else None
    return {"nodes": int(g.known.sum()), "many": int((sizes > 0).sum()), "largest": int(sizes.max()), "modularity": score}
