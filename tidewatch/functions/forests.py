"""Trees that learn row by row. Each kernel is one member; a forest is a mean over members.

Nodes are lists or small objects addressed from the root; a kernel returns what
its tree says of the row (a path length, a displacement) before learning it.
"""

from __future__ import annotations

import math
import struct
from collections import deque

import numpy as np

from tidewatch.functions.kernels import Kernel

EULER = 0.5772156649015329


def isolation_norm(n: float, two: float | None = None) -> float:
    """Mean path length of an unsuccessful search among n rows; two: its value for n = 2, if fixed."""
    if n <= 1:
        return 0.0
    if n == 2 and two is not None:
        return two
    return 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


class AsdForest(Kernel):
    """Isolation trees built from full buffers; the last row of a buffer begins the next one."""

    def __init__(self, n_estimators=100, max_samples=256, seed=1):
        if max_samples < 2:
            raise ValueError("max_samples must be at least 2")
        self.size = max_samples
        self.rng = np.random.default_rng(seed)
        self.trees: deque = deque(maxlen=n_estimators)
        self.buffer: list[tuple] = []

    def _grow(self, rows: np.ndarray, depth: int):
        if len(rows) <= 1 or depth == 0:
            return isolation_norm(len(rows))
        f = int(self.rng.integers(rows.shape[1]))
        low, high = rows[:, f].min(), rows[:, f].max()
        if low == high:
            return isolation_norm(len(rows))
        cut = self.rng.uniform(low, high)
        below = rows[:, f] < cut
        return f, cut, self._grow(rows[below], depth - 1), self._grow(rows[~below], depth - 1)

    @staticmethod
    def _path(tree, x) -> float:
        steps = 0
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
            steps += 1
        return steps + tree

    def score(self, row):
        if not self.trees:
            return (0.0,)
        mean = sum(self._path(t, row) for t in self.trees) / len(self.trees)
        return (2.0 ** (-mean / isolation_norm(self.size)),)

    def step(self, row):
        out = self.score(row)
        self.buffer.append(row)
        if len(self.buffer) == self.size:
            self.trees.append(self._grow(np.array(self.buffer, float), math.ceil(math.log2(self.size))))
            self.buffer = [row]
        return out


class _Box:
    """A node of a cut tree: a bounding box, and two children with a cut, or a point with its copies."""

    __slots__ = ("low", "high", "n", "cut", "kids", "up", "time")

    def __init__(self, x: np.ndarray):
        self.low, self.high, self.n, self.cut, self.kids, self.up, self.time = x, x, 1, None, None, None, 0.0

    def side(self, x: np.ndarray) -> int:
        f, at = self.cut
        return 0 if x[f] <= at else 1

    def refresh(self) -> None:
        a, b = self.kids
        self.low, self.high, self.n = np.minimum(a.low, b.low), np.maximum(a.high, b.high), a.n + b.n
        a.up = b.up = self


def _joined(old: _Box, new: _Box, cut: tuple[int, float]) -> _Box:
    """A node above both, in the place of old."""
    top = _Box(new.low)
    top.up, top.cut = old.up, cut
    top.kids = [new, old] if new.low[cut[0]] <= cut[1] else [old, new]
    if top.up is not None:
        top.up.kids[top.up.kids.index(old)] = top
    top.refresh()
    return top


def _to_root(node: _Box | None) -> None:
    while node is not None:
        node.refresh()
        node = node.up


class RandomCutTree(Kernel):
    """A random cut tree over a first-in, first-out window; the row's displacement, widened by its distance."""

    def __init__(self, sample_size=256, warmup=None, seed=1, member=0, normalize=True, scale=8.0):
        self.size, self.warm = sample_size, sample_size if warmup is None else warmup
        self.rng = np.random.default_rng((seed, member))
        self.root: _Box | None = None
        self.leaves: deque[_Box] = deque()
        self.seen, self.normalize, self.scale = 0, normalize, scale

    def twin(self):
        if type(self) is RandomCutTree and not self.seen:
            drawn = self.rng.bit_generator.state["state"]
            return "rcf", struct.pack("<iq", self.size, self.warm) + struct.pack("<4Q", *[w for v in (drawn["state"], drawn["inc"]) for w in (v >> 64, v % 2**64)])

    def _leaf(self, x: np.ndarray) -> _Box:
        node = self.root
        while node.kids:
            node = node.kids[node.side(x)]
        return node

    def _score(self, x: np.ndarray) -> float:
        leaf = node = self._leaf(x)
        most = 0.0
        while node.up is not None:
            most = max(most, (node.up.n - node.n) / node.n)
            node = node.up
        span = float((self.root.high - self.root.low).sum()) + 1e-12
        return most * (1 + float(np.abs(x - leaf.low).sum()) / span)

    def _cut(self, low: np.ndarray, high: np.ndarray) -> tuple[int, float]:
        sides = np.cumsum(high - low)
        at = self.rng.random() * sides[-1]
        f = min(int(np.searchsorted(sides, at, "right")), len(sides) - 1)
        return f, float(low[f] + at - (sides[f - 1] if f else 0.0))

    def _insert(self, x: np.ndarray) -> _Box:
        new = _Box(x)
        if self.root is None:
            self.root = new
            return new
        node = self.root
        while True:
            low, high = np.minimum(node.low, x), np.maximum(node.high, x)
            if not node.kids and np.array_equal(node.low, x):
                node.n += 1
                _to_root(node.up)
                return node
            f, at = self._cut(low, high)
            if not node.kids or not node.low[f] < at < node.high[f]:
                if not node.kids and (node.low[f] <= at) == (x[f] <= at):
                    at = float((low[f] + high[f]) / 2)
                if (node.high[f] <= at) != (x[f] <= at) or (node.low[f] > at) != (x[f] > at):
                    top = _joined(node, new, (f, at))
                    if top.up is None:
                        self.root = top
                    _to_root(top.up)
                    return new
                if not node.kids:
                    continue
            node = node.kids[node.side(x)]

    def _remove(self, leaf: _Box) -> None:
        if leaf.n > 1:
            leaf.n -= 1
            _to_root(leaf.up)
            return
        top = leaf.up
        if top is None:
            self.root = None
            return
        other = top.kids[1 - top.kids.index(leaf)]
        other.up = top.up
        if top.up is None:
            self.root = other
        else:
            top.up.kids[top.up.kids.index(top)] = other
        _to_root(other.up)

    def score(self, row):
        return (self._score(np.array(row, float)) if self.seen >= self.warm and self.root is not None else 0.0,)

    def step(self, row):
        x = np.array(row, float)
        out = self.score(row)
        self.leaves.append(self._insert(x))
        if len(self.leaves) > self.size:
            self._remove(self.leaves.popleft())
        self.seen += 1
        return out


class MondrianTree(Kernel):
    """A Mondrian tree with a lifetime; the row's depth with the correction of its leaf."""

    def __init__(self, n_features=1, subspace_size=256, lifetime=1.0, seed=1, member=0):
        self.rng = np.random.default_rng((seed, member))
        size = min(subspace_size, n_features)
        self.dims = np.sort(self.rng.choice(n_features, size, replace=False))
        self.life, self.root = lifetime, None

    def _extend(self, x: np.ndarray) -> None:
        if self.root is None:
            self.root = _Box(x)
            self.root.time = self.life
            return
        node, since = self.root, 0.0
        while True:
            outside = np.maximum(node.low - x, 0) + np.maximum(x - node.high, 0)
            rate = float(outside.sum())
            born = since + (self.rng.exponential(1 / rate) if rate > 0 else math.inf)
            if born < node.time:
                f = int(np.searchsorted(np.cumsum(outside), self.rng.random() * rate))
                f = min(f, len(x) - 1)
                at = self.rng.uniform(node.high[f], x[f]) if x[f] > node.high[f] else self.rng.uniform(x[f], node.low[f])
                new = _Box(x)
                new.time = self.life
                top = _joined(node, new, (f, float(at)))
                top.time = born
                if top.up is None:
                    self.root = top
                _to_root(top.up)
                return
            if not node.kids:
                node.low, node.high, node.n = np.minimum(node.low, x), np.maximum(node.high, x), node.n + 1
                _to_root(node.up)
                return
            since = node.time
            node = node.kids[node.side(x)]

    def score(self, row):
        if self.root is None:
            return (0.0,)
        x = np.array(row, float)[self.dims]
        node, steps = self.root, 0
        while node.kids:
            node = node.kids[node.side(x)]
            steps += 1
        return (steps + isolation_norm(node.n, 1.0),)

    def step(self, row):
        out = self.score(row)
        self._extend(np.array(row, float)[self.dims])
        return out


class _Cell:
    __slots__ = ("n", "depth", "low", "high", "axis", "cuts", "kids")

    def __init__(self, rows: np.ndarray, depth: int):
        self.n, self.depth = len(rows), depth
        self.low, self.high = (rows.min(0), rows.max(0)) if len(rows) else (None, None)
        self.kids = None


class OnlineTree(Kernel):
    """A tree that splits crowded leaves on uniform stand-ins for their rows, and merges thin ones as rows leave.

    The row's depth with the expected depth of what its leaf holds. batched: a row's
    last value is the number of its batch; a batch is scored as a whole before it is
    learned, and learned as a whole before the oldest rows leave.
    """

    def __init__(self, max_leaf=32, adaptive=True, subsample=1.0, window_size=2048, branches=2, seed=1, member=0, batched=False):
        self.leaf, self.adaptive, self.share, self.window, self.b = max_leaf, adaptive, subsample, window_size, branches
        self.rng = np.random.default_rng((seed, member))
        self.rows: deque[np.ndarray] = deque()
        self.n, self.root = 0, None
        self.batched, self.batch, self.waiting = batched, None, []

    def _need(self, depth: int) -> int:
        return self.leaf * (2**depth if self.adaptive else 1)

    def expected(self, n: float) -> float:
        return math.log(n / self.leaf) / math.log(2 * self.b) if n >= self.leaf else 0.0

    def _build(self, rows: np.ndarray, depth: int) -> _Cell:
        cell = _Cell(rows, depth)
        if cell.n < self._need(depth) or depth >= self.expected(self.n):
            return cell
        cell.axis = int(self.rng.integers(rows.shape[1]))
        values = rows[:, cell.axis]
        cell.cuts = np.sort(self.rng.uniform(values.min(), values.max(), self.b - 1))
        part = np.searchsorted(cell.cuts, values, "right")
        cell.kids = [self._build(rows[part == k], depth + 1) for k in range(self.b)]
        return cell

    def _add(self, x: np.ndarray) -> None:
        if self.root is None:
            self.root = self._build(x[None], 0)
            return
        cell, above, at = self.root, None, 0
        while True:
            cell.n += 1
            cell.low = x if cell.low is None else np.minimum(cell.low, x)
            cell.high = x if cell.high is None else np.maximum(cell.high, x)
            if not cell.kids:
                break
            above, at = cell, int(np.searchsorted(cell.cuts, x[cell.axis], "right"))
            cell = above.kids[at]
        if cell.n >= self._need(cell.depth) and cell.depth < self.expected(self.n):
            built = self._build(self.rng.uniform(cell.low, cell.high, (cell.n, len(x))), cell.depth)
            if above is None:
                self.root = built
            else:
                above.kids[at] = built

    def _drop(self, x: np.ndarray) -> None:
        cell, path = self.root, []
        while cell is not None:
            cell.n -= 1
            if not cell.kids:
                break
            if cell.n < self._need(cell.depth):
                cell.kids = None
                break
            path.append(cell)
            cell = cell.kids[int(np.searchsorted(cell.cuts, x[cell.axis], "right"))]
        for up in reversed(path):
            held = [k for k in up.kids if k.low is not None]
            if held:
                up.low, up.high = np.min([k.low for k in held], 0), np.max([k.high for k in held], 0)

    def depth(self, x: np.ndarray) -> float:
        if self.root is None:
            return 0.0
        cell = self.root
        while cell.kids:
            cell = cell.kids[int(np.searchsorted(cell.cuts, x[cell.axis], "right"))]
        return cell.depth + self.expected(cell.n)

    def learn(self, rows: list[np.ndarray]) -> None:
        taken = [x for x in rows if self.rng.random() < self.share]
        self.n += len(taken)
        for x in taken:
            self._add(x)
        self.rows.extend(rows)
        old = [self.rows.popleft() for _ in range(len(self.rows) - self.window)]
        gone = [x for x in old if self.rng.random() < self.share] if self.root is not None else []
        self.n -= len(gone)
        for x in gone:
            self._drop(x)

    def score(self, row):
        """Of the tree as it is; a waiting batch isn't learned for a row of the next one."""
        x = np.array(row, float)
        return (self.depth(x[:-1] if self.batched else x),)

    def step(self, row):
        x = np.array(row, float)
        if not self.batched:
            depth = self.depth(x)
            self.learn([x])
            return (depth,)
        if x[-1] != self.batch:
            self.learn(self.waiting)
            self.batch, self.waiting = x[-1], []
        self.waiting.append(x[:-1])
        return (self.depth(x[:-1]),)
