"""difflib's matching-blocks ratio of a text against many, to the last bit."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Pairs of equal characters that are held at once; with more, difflib itself is asked.
PAIRS = 2_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _common(a: str, i: int, b: str, j: int, most: int) -> int:
    """Equal characters from places i and j on."""
    step, n = 16, 0
    while n < most:
        size = min(step, most - n)
        if a[i + n : i + n + size] == b[j + n : j + n + size]:
            n, step = n + size, step * 4
        elif size == 1:
            break
        else:
            step = max(1, size // 2)
            most = n + size - 1
    return n


class Ratio:
    """SequenceMatcher(None, a, b).ratio() of one b. Where it can't reach least, it may be 0 instead.

    difflib takes from a range the longest run of characters that are not
    frequent in b, the first of equal ones, widens it by any equal characters,
    and goes on left and right of it. Runs are found here from all pairs of
    equal characters that are not frequent: how long a run of such pairs is at
    its end is known beforehand, and a range only cuts it.
    """

    def __init__(self, b: str):
        self.b, self.reverse = b, b[::-1]
        codes = _codes(b)
        order = np.argsort(codes, kind="stable")
        self.found, first, count = np.unique(codes[order], return_index=True, return_counts=True)
        frequent = len(b) // 100 + 1 if len(b) >= 200 else len(b)
        self.at, self.first, self.count = order, first, np.where(count > frequent, 0, count)

    def __call__(self, a: str, least: float = 0.0) -> float:
        b = self.b
        if a == b:
            return 1.0
        codes = _codes(a)
        if not len(codes) or not b:
            return 0.0
        known = np.minimum(np.searchsorted(self.found, codes), len(self.found) - 1)
        times = np.where(self.found[known] == codes, self.count[known], 0)
        if times.sum() > PAIRS:
            return SequenceMatcher(None, a, b).ratio()
        i = np.repeat(np.arange(len(a)), times)
        ends = np.cumsum(times)
        j = self.at[np.repeat(self.first[known], times) + np.arange(len(i)) - np.repeat(ends - times, times)]
        order = np.argsort((j - i + len(a)) * (len(a) + 1) + i)
        goes_on = np.zeros(len(i), bool)
        goes_on[1:] = (np.diff(i[order]) == 1) & (np.diff(j[order]) == 1)
        place = np.arange(len(i))
        run = np.empty(len(i), np.int64)
        run[order] = place - np.maximum.accumulate(np.where(goes_on, 0, place)) + 1
        starts = np.concatenate([[0], ends])
        backwards, total = a[::-1], len(a) + len(b)
        matched, open_, todo = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
        while todo:
            if 2.0 * (matched + open_) / total < least - 1e-9:
                return 0.0
            alo, ahi, blo, bhi = todo.pop()
            open_ -= min(ahi - alo, bhi - blo)
            x, y, k = alo, blo, 0
            part = slice(starts[alo], starts[ahi])
            if part.start < part.stop:
                jj, ii = j[part], i[part]
                size = np.minimum(np.minimum(run[part], ii - alo + 1), jj - blo + 1)
                size[(jj < blo) | (jj >= bhi)] = 0
                best = int(size.argmax())
                if (k := int(size[best])) > 0:
                    x, y = int(ii[best]) - k + 1, int(jj[best]) - k + 1
                else:
                    k = 0
            before = _common(backwards, len(a) - x, self.reverse, len(b) - y, min(x - alo, y - blo))
            x, y, k = x - before, y - before, k + before
            k += _common(a, x + k, b, y + k, min(ahi - x - k, bhi - y - k))
            if k:
                matched += k
                for z in ((alo, x, blo, y), (x + k, ahi, y + k, bhi)):
                    if (n := min(z[1] - z[0], z[3] - z[2])) > 0:
                        open_ += n
                        todo.append(z)
        return 2.0 * matched / total
