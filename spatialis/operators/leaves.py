"""Leaves of a k-d tree: places of a group dealt into parts of bounded size, each searched by itself.

The tree is built on the driver from a bounded sample, over groups too large for one leaf; smaller groups are
one leaf. A leaf's own search runs in NumPy over blocks of places with their boxes. Only places whose ball
reaches over their leaf's edge ask the leaves there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Places of a leaf, most leaves of a tree, and sampled places of the whole tree.
LEAF, LEAVES, SAMPLE = 8192, 4096, 1 << 17
#: Places of a block of a leaf's own search.
BLOCK = 64


@dataclass
class Tree:
    """Splits of one group: axis, cut, and the two nodes or (negative: -1 - leaf) leaves below each node; a leaf's
    box is where no split says otherwise endless."""

    axis: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    below: list[list[int]] = field(default_factory=list)
    boxes: list[tuple[float, float, float, float]] = field(default_factory=list)

    @classmethod
    def of(cls, sample: np.ndarray, size: int, leaf: int) -> Tree:
        """Medians of the sample part a group of `size` places until each part has about `leaf` of them."""
        tree = cls()

        def part(points: np.ndarray, box: tuple[float, float, float, float]) -> int:
            span = np.ptp(points, axis=0) if len(points) else np.zeros(2)
            if len(points) >= 8 and size * len(points) / len(sample) > leaf and span.max() > 0:
                a = int(span.argmax())
                cut = float(np.median(points[:, a]))
                low = points[:, a] <= cut
                if low.all():  # the median is the greatest value: it goes to the upper part alone
                    cut = float(points[:, a][points[:, a] < cut].max())
                    low = points[:, a] <= cut
                node = len(tree.axis)
                tree.axis.append(a)
                tree.cut.append(cut)
                tree.below.append([0, 0])
                under, over = list(box), list(box)
                under[2 + a], over[a] = cut, cut
                tree.below[node] = [part(points[low], tuple(under)), part(points[~low], tuple(over))]
                return node
            tree.boxes.append(box)
            return -len(tree.boxes)

        part(sample, (-np.inf, -np.inf, np.inf, np.inf))
        return tree

    def leaf_of(self, xy: np.ndarray) -> np.ndarray:
        """The leaf of each place."""
        out = np.zeros(len(xy), np.int64)
        if not self.axis:
            return out
        axis, cut, below = np.array(self.axis), np.array(self.cut), np.array(self.below)
        node, left = np.zeros(len(xy), np.int64), np.arange(len(xy))
        while len(left):
            at = node[left]
            node[left] = below[at, (xy[left, axis[at]] > cut[at]).astype(int)]
            out[left] = -1 - node[left]
            left = left[node[left] >= 0]
        return out

    def reached(self, xy: np.ndarray, radius: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, leaf): the leaves but `own` whose box the ball around a place reaches, its edge included."""
        boxes = np.array(self.boxes)
        asks, leaves, some = [], [], max(1, (1 << 22) // max(1, len(boxes)))
        for i in range(0, len(xy), some):
            gap = np.maximum(np.maximum(boxes[None, :, :2] - xy[i : i + some, None], xy[i : i + some, None] - boxes[None, :, 2:]), 0)
            hit = (gap**2).sum(axis=2) <= (radius[i : i + some] ** 2 * (1 + 1e-9))[:, None]
            hit[:, own] = False
            at, leaf = np.nonzero(hit)
            asks.append(at + i)
            leaves.append(leaf)
        return np.concatenate([np.empty(0, np.int64), *asks]), np.concatenate([np.empty(0, np.int64), *leaves])


class Blocks:
    """Places ordered into blocks by halving along the wider axis, with the blocks' boxes."""

    def __init__(self, xy: np.ndarray, size: int = BLOCK) -> None:
        parts, self.bounds = [np.arange(len(xy))], []
        done: list[np.ndarray] = []
        while parts:
            own = parts.pop()
            if len(own) <= size:
                done.append(own)
                continue
            a = int(np.ptp(xy[own], axis=0).argmax())
            half = len(own) // 2
            order = own[np.argpartition(xy[own, a], half)]
            parts += [order[half:], order[:half]]
        self.order = np.concatenate(done) if done else np.empty(0, np.int64)
        self.xy = xy[self.order]
        ends = np.cumsum([len(p) for p in done])
        self.start, self.end = np.concatenate([[0], ends[:-1]]).astype(int), ends.astype(int)
        if len(xy):
            self.low, self.high = (np.array([f(xy[p], axis=0) for p in done]) for f in (np.min, np.max))

    def __len__(self) -> int:
        return len(self.start)

    def gap2(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distances of boxes to the blocks' boxes."""
        gap = np.maximum(np.maximum(self.low[None] - high[:, None], low[:, None] - self.high[None]), 0)
        return (gap**2).sum(axis=2)

    def span2(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared largest distances between boxes and the blocks' boxes."""
        span = np.maximum(self.high[None] - low[:, None], high[:, None] - self.low[None])
        return (span**2).sum(axis=2)

    def members(self, blocks: np.ndarray) -> np.ndarray:
        """Places (in the blocks' order) of some blocks."""
        return np.concatenate([np.arange(self.start[b], self.end[b]) for b in blocks.tolist()]) if len(blocks) else np.empty(0, np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all of a to all of b."""
    return (a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2


def _first(d2: np.ndarray, ids: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, d2) of each row's k nearest columns not farther than its `most`, ties to the smaller id."""
    if d2.shape[1] > k:
        most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1])
    row, column = np.nonzero(d2 <= most[:, None])
    own = d2[row, column]
    order = np.lexsort((ids[column], own, row))
    row, column, own = row[order], column[order], own[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], column[keep], own[keep]


def nearest(asked: np.ndarray, most: np.ndarray, xy: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, place, d2): the k nearest places of each asked one, none farther than sqrt(most); ordered by
    asked, distance and id."""
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(asked) or not len(xy):
        return empty
    there, here = Blocks(xy, max(BLOCK, k)), Blocks(asked)
    there_ids = ids[there.order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def search(own: np.ndarray) -> None:
        """The answers for some places, near to each other: the blocks nearest to them bound how far they must look."""
        at = asked[own]
        low, high = at.min(axis=0)[None], at.max(axis=0)[None]
        gap = there.gap2(low, high)[0]
        by_gap = np.argsort(gap, kind="stable")
        first = there.members(by_gap[: int(np.searchsorted(np.cumsum((there.end - there.start)[by_gap]), k)) + 1])
        bound = most[own].copy()
        if len(first) >= k:
            bound = np.minimum(bound, np.partition(squared(at, there.xy[first]), k - 1, axis=1)[:, k - 1])
        if len(own) > 8 and bound.max() > 4 * np.median(bound) + 1e-300:
            # Lonely places look far, and by themselves.
            far = bound > 4 * np.median(bound)
            search(own[~far])
            for i in np.flatnonzero(far).tolist():
                search(own[[i]])
            return
        near = there.members(np.flatnonzero(gap <= bound.max()))
        row, column, d2 = _first(squared(at, there.xy[near]), there_ids[near], k, bound)
        found.append((own[row], there.order[near[column]], d2))

    for i in range(len(here)):
        search(here.order[here.start[i] : here.end[i]])
    own, place, d2 = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids[place], d2, own))
    return own[order], place[order], d2[order]


def weight_within(asked: np.ndarray, xy: np.ndarray, weight: np.ndarray, radius: float) -> np.ndarray:
    """The weight of the places within the radius of each asked one. Boxes wholly inside add their totals and
    boxes outside nothing; a pair of boxes at the edge is halved, and only the smallest meet place by place."""
    out = np.zeros(len(asked), weight.dtype)
    if not len(asked) or not len(xy):
        return out
    here, there = Blocks(asked), Blocks(xy)
    r2 = float(radius) ** 2
    own = weight[there.order]
    sums = np.concatenate([[0], np.cumsum(own)])
    total = sums[there.end] - sums[there.start]
    for i in range(len(here)):
        at = here.order[here.start[i] : here.end[i]]
        box = here.low[i][None], here.high[i][None]
        inside = there.span2(*box)[0] <= r2 * (1 - 1e-9)
        edge = ~inside & (there.gap2(*box)[0] <= r2 * (1 + 1e-9))
        out[at] = total[inside].sum()
        if edge.any():
            near = there.members(np.flatnonzero(edge))
            out[at] += (squared(asked[at], there.xy[near]) <= r2) @ own[near]
    return out
