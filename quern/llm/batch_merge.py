"""BPE merges of many chunks at once: one numpy round joins the best pair of every chunk."""

from __future__ import annotations

import numpy as np

_NONE = np.int32(2**31 - 1)
_FOREIGN = -2  # a symbol that joins nothing and is no piece
_BITS = 20


class PairTable:
    """(left symbol, right symbol) -> (rank of the joined piece, its id), open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, joined: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(1, left.size) * 4))))
        n = 1 << self.bits
        self.keys = np.full(n, -1, np.int64)
        self.at = np.zeros(n, np.int32)
        self.rank, self.joined = rank.astype(np.int32), joined.astype(np.int32)
        keys = left.astype(np.int64) << _BITS | right
        todo, slot = np.arange(keys.size), self._slot(keys)
        while todo.size:
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            chosen = np.zeros(todo.size, bool)
            chosen[first] = True
            chosen &= free
            self.keys[slot[chosen]], self.at[slot[chosen]] = keys[todo[chosen]], todo[chosen]
            todo, slot = todo[~chosen], (slot[~chosen] + ~free[~chosen]) & (n - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << _BITS | right.astype(np.int64)
        rank, joined = np.full(keys.shape, _NONE, np.int32), np.full(keys.shape, -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[todo]
        slot = self._slot(keys)
        while todo.size:
            there = self.keys[slot]
            hit = there == keys
            at = self.at[slot[hit]]
            rank.ravel()[todo[hit]], joined.ravel()[todo[hit]] = self.rank[at], self.joined[at]
            go = ~hit & (there != -1)
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & (self.keys.size - 1)
        return rank, joined


class BatchMerger:
    """pieces: text -> id; costs: the smaller joins first; byte_ids: id of each byte."""

    def __init__(self, pieces: dict[str, int], costs: dict[str, float], byte_ids: dict[int, int]):
        self.n = max(pieces.values(), default=0) + 1
        chars = {c for p in pieces for c in p}
        symbols = dict(pieces)
        for c in sorted(chars):  # characters that stand only inside longer pieces
            symbols.setdefault(c, self.n + len(symbols))
        ranks = {c: r for r, c in enumerate(sorted(set(costs.values())))}
        found = [(symbols[p[:k]], symbols[p[k:]], ranks[costs[p]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.pairs = PairTable(*np.array(found or [(0, 0, 0, 0)], np.int64).T)
        if not found:
            self.pairs.keys[:] = -1
        self.by_code = np.full(0x110000, _FOREIGN, np.int32)
        for byte, i in byte_ids.items():
            if byte < 128 and chr(byte) not in symbols:
                self.by_code[byte] = i  # one byte is the whole character
        for c in chars:
            self.by_code[ord(c)] = symbols[c]

    def merge(self, chunks: list[str]) -> list[bytes | None]:
        """The ids of each chunk (int32), None for a chunk that holds characters without a piece."""
        size = np.array([len(c) for c in chunks])
        codes = self.by_code[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        begin = np.cumsum(size) - size
        out: list[bytes | None] = [None] * len(chunks)
        order = np.argsort(size, kind="stable")
        for at in range(0, order.size, 4096):  # alike in length, so that little is padded
            rows = order[at : at + 4096]
            width = int(size[rows[-1]])
            place = begin[rows][:, None] + np.arange(width)
            inside = np.arange(width) < size[rows][:, None]
            s = np.where(inside, codes[np.minimum(place, codes.size - 1)], -1)
            good = ~(s == _FOREIGN).any(axis=1)
            self._rounds(s)
            good &= (s < self.n).all(axis=1)
            left = s >= 0
            data, ends = s[left].astype(np.int32).tobytes(), np.cumsum(left.sum(axis=1)) * 4
            start = 0
            for row, ok, end in zip(rows.tolist(), good.tolist(), ends.tolist()):
                if ok:
                    out[row] = data[start:end]
                start = end
        return out

    def _rounds(self, s: np.ndarray) -> None:
        m, width = s.shape
        if width < 2:
            return
        after = np.tile(np.arange(1, width + 1), (m, 1))
        before = np.tile(np.arange(-1, width - 1), (m, 1))
        cost, joined = self.pairs.find(s[:, :-1], s[:, 1:])
        rows = np.arange(m)
        while rows.size:
            k = cost[rows].argmin(axis=1)
            live = cost[rows, k] != _NONE
            rows, k = rows[live], k[live]
            if not rows.size:
                break
            gone = after[rows, k]
            new = joined[rows, k]
            follow = after[rows, gone]
            s[rows, k], s[rows, gone] = new, -1
            after[rows, k] = follow
            cost[rows, np.minimum(gone, width - 2)] = np.where(gone <= width - 2, _NONE, cost[rows, width - 2])
            has = follow < width
            before[rows[has], follow[has]] = k[has]
            right = np.where(has, s[rows, np.minimum(follow, width - 1)], -1)
            c, j = self.pairs.find(new, right)
            edge = k <= width - 2
            cost[rows[edge], k[edge]], joined[rows[edge], k[edge]] = c[edge], j[edge]
            prior = before[rows, k]
            has = prior >= 0
            r, p = rows[has], prior[has]
            c, j = self.pairs.find(s[r, p], new[has])
            cost[r, p], joined[r, p] = c, j
