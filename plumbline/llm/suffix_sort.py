"""Suffix sort by comparing hashes.

The polynomial prefix hashes of a byte string give the hash of any stretch, so the common extension
of two suffixes is found by binary search over its length, and two suffixes are compared in
logarithmic time: at the first byte behind their common extension. The suffixes are then sorted by
merging. Extensions found by hash are verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from .common import Rolling

#: One set of powers for all sorts of a task.
ROLLING = Rolling(seed=4)


class Suffixes:
    """Places in a byte string, sorted by the up to ``depth`` bytes that follow them.

    ``ends`` gives the end of the stretch each place may look at; a shorter suffix sorts first.
    """

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        self.prefix = ROLLING.prefix(data)
        self.verify = False             # whether every comparison checks the bytes

    def common(self, a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions at places a and b, by binary search on hashes."""
        most = np.minimum(np.minimum(ea - a, eb - b), self.depth)
        low, high = np.zeros_like(most), most.copy()
        inverse = ROLLING.inverse
        ia, ib = inverse[a], inverse[b]
        pa, pb = self.prefix[a], self.prefix[b]
        for _ in range(int(self.depth).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - pa) * ia == (self.prefix[b + middle] - pb) * ib
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        return self._verified(a, b, low) if self.verify else low

    def _verified(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The lengths, cut at the first byte that differs where hashes collided."""
        for start in range(0, len(a), 4096):
            part = slice(start, start + 4096)
            n = int(length[part].max(initial=0))
            if not n:
                continue
            steps = np.arange(n)
            inside = steps < length[part, None]
            last = len(self.data) - 1
            wrong = inside & (self.data[np.minimum(a[part, None] + steps, last)]
                              != self.data[np.minimum(b[part, None] + steps, last)])
            if wrong.any():
                first = np.where(wrong.any(1), wrong.argmax(1), length[part])
                length[part] = first
        return length

    def less(self, a, ea, b, eb) -> np.ndarray:
        """Whether the suffix at a sorts before or with that at b."""
        n = self.common(a, ea, b, eb)
        end_a, end_b = n >= np.minimum(ea - a, self.depth), n >= np.minimum(eb - b, self.depth)
        last = len(self.data) - 1
        byte = (self.data[np.minimum(a + n, last)] <= self.data[np.minimum(b + n, last)])
        return np.where(end_a, True, np.where(end_b, False, byte))

    def sort(self, places: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the places within each group (groups lie together, in rising order).

        Bottom-up mergesort: in each round, every element finds its rank in the neighbouring run by
        binary search, for all runs at once.
        """
        n = len(places)
        order = np.arange(n)
        sizes = np.bincount(group)
        first = np.concatenate(([0], np.cumsum(sizes)))[group]
        size = sizes[group]
        width = 1
        while width < (sizes.max() if n else 0):
            slot = np.arange(n) - first             # place inside the group
            run = slot // width
            other = run ^ 1
            low = first + np.minimum(other * width, size)
            high = first + np.minimum((other + 1) * width, size)
            start = low.copy()
            left = run % 2 == 0
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                mine, its = order[open_], order[middle]
                # Elements of the left run go before equals of the right run.
                swap = left[open_]
                x, y = np.where(swap, mine, its), np.where(swap, its, mine)
                le = self.less(places[x], ends[x], places[y], ends[y])
                go_right = np.where(swap, ~le, le)
                low[open_] = np.where(go_right, middle + 1, low[open_])
                high[open_] = np.where(go_right, high[open_], middle)
            pair = first + (run // 2) * 2 * width
            target = pair + (slot - run * width) + (low - start)
            new = np.empty_like(order)
            new[target] = order
            order = new
            width *= 2
        return order

    def ordered(self, places: np.ndarray, ends: np.ndarray,
                group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): the places sorted within their groups, and each one's common extension
        with the one before it (-1 for the first of a group).

        The extensions are verified byte by byte. Where a hash collision shows, all is sorted again
        with every comparison verified.
        """
        order = self.sort(places, ends, group)
        if len(order) < 2:
            return order, np.full(len(order), -1, np.int64)
        a, b = order[:-1], order[1:]
        found = self.common(places[a], ends[a], places[b], ends[b])
        true = found if self.verify else self._verified(places[a], places[b], found.copy())
        if (true != found).any():
            self.verify = True
            return self.ordered(places, ends, group)
        return order, np.concatenate(([-1], np.where(group[a] == group[b], true, -1)))
