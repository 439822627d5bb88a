"""Kernels with learned state other than trees: observers, hashes, graphs, kernels and networks."""

from __future__ import annotations

import hashlib
import math
import struct
from collections import OrderedDict, defaultdict, deque

import numpy as np

from tidewatch.functions.kernels import Ageing, Kernel

DISTANCES = {
    "euclidean": lambda gap, p: np.sqrt((gap * gap).sum(1)),
    "manhattan": lambda gap, p: np.abs(gap).sum(1),
    "chebyshev": lambda gap, p: np.abs(gap).max(1),
    "minkowski": lambda gap, p: (np.abs(gap) ** p).sum(1) ** (1 / p),
}


class SdoStream(Ageing):
    """Distance to the nearest active observers; observers are sampled and fade."""

    def __init__(self, k=256, horizon=512, idle=0.3, neighbours=6, distance="euclidean", p=2, warm_up=None, seed=1, timed=False):
        super().__init__(timed)
        if distance not in DISTANCES:
            raise ValueError(f"unknown distance {distance!r}")
        self.k, self.x, self.idle, self.p = k, neighbours, idle, p
        self.horizon, self.distance = horizon, DISTANCES[distance]
        self.warm = neighbours if warm_up is None else warm_up
        self.rng = np.random.default_rng(seed)
        self.at: list[np.ndarray] = []
        self.mass, self.born, self.touched = np.zeros(k), np.zeros(k), np.zeros(k)
        self.now, self.last, self.last_at = 0.0, 0, 0.0

    def __getstate__(self):
        state = self.__dict__.copy()
        state["distance"] = next(k for k, f in DISTANCES.items() if f is self.distance)
        return state

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.distance = DISTANCES[state["distance"]]

    def _faded(self, now: float) -> np.ndarray:
        m = len(self.at)
        return self.mass[:m] * np.exp(-(now - self.touched[:m]) / self.horizon)

    def score(self, row):
        return (self._score(*self.when(row)),)

    def _score(self, x: np.ndarray, now: float) -> float:
        m = len(self.at)
        active = min(m, max(self.x, int((1 - self.idle) * m)))
        if m < self.warm or active < self.x:
            return 0.0
        best = np.argsort(self._faded(now), kind="stable")[m - active :]
        d = self.distance(np.array(self.at)[best] - x, self.p)
        return float(np.median(np.sort(d)[: self.x]))

    def _place(self, i: int, x: np.ndarray) -> None:
        self.at[i : i + 1] = [x]
        self.mass[i], self.born[i], self.touched[i] = 1.0, self.now, self.now
        self.last, self.last_at = self.n, self.now

    def info(self):
        return {"n_samples_seen": [float(self.n)], "n_observers": [float(len(self.at))]}

    def step(self, row):
        x, self.now = self.when(row)
        self.newest = self.now
        score = self._score(x, self.now)
        if not self.at:
            self._place(0, x)
        else:
            near = np.argsort(self.distance(np.array(self.at) - x, self.p), kind="stable")[: self.x]
            self.mass[near] = self.mass[near] * np.exp(-(self.now - self.touched[near]) / self.horizon) + 1
            self.touched[near] = self.now
            odds = self.k**2 / (self.x * self.horizon) * self.mass[near].sum() * max(1.0, self.now - self.last_at)
            if self.rng.random() * self._faded(self.now).sum() * max(1, self.n - self.last) < odds:
                m = len(self.at)
                worth = self._faded(self.now) / np.maximum(self.now - self.born[:m], 1)
                self._place(m if m < self.k else int(worth.argmin()), x)
        self.n += 1
        return (score,)


PRIME = 2147483647


class RsHash(Ageing):
    """Occupancy of randomly shifted grid cells in random subspaces, hashed and faded."""

    def __init__(self, n_features=1, components=24, hashes=4, bins=256, subspace=None, width=1.0, decay=0.01, warm_up=64, seed=1, timed=False):
        super().__init__(timed)
        rng = np.random.default_rng(seed)
        r = min(n_features, subspace or math.ceil(math.sqrt(n_features)))
        self.dims = np.array([np.sort(rng.choice(n_features, r, replace=False)) for _ in range(components)])
        self.shift = rng.uniform(0, width, (components, r))
        self.a = rng.integers(1, PRIME, (components, hashes, r))
        self.b = rng.integers(0, PRIME, (components, hashes))
        self.counts = np.zeros((components, hashes, bins))
        self.width, self.decay, self.warm, self.bins = width, decay, warm_up, bins
        self.last, self.mean, self.m2 = None, np.zeros(n_features), np.zeros(n_features)

    def info(self):
        return {"n_samples_seen": [float(self.n)], "is_ready": [float(self.n >= self.warm)]}

    def _cells(self, x: np.ndarray) -> np.ndarray:
        """The bin of each component and hash."""
        z = x if self.n == 0 else x - self.mean
        if self.n >= 2:
            z = z / np.maximum(np.sqrt(self.m2 / (self.n - 1)), 1e-6)
        cell = np.floor((z[self.dims] + self.shift) / self.width).astype(np.int64) % PRIME
        # Products stay below 2^62; the sum is reduced term by term.
        total = self.b.copy()
        for d in range(cell.shape[1]):
            total = (total + self.a[:, :, d] * cell[:, None, d] % PRIME) % PRIME
        return (total % self.bins)[..., None]

    def _faded(self, now: float) -> float:
        return 1.0 if self.last is None else math.exp(-self.decay * (now - self.last))

    def _score(self, held: np.ndarray) -> float:
        if self.n < self.warm:
            return 0.0
        return float(np.clip(1 - np.log1p(held.min(1)) / math.log1p(max(self.n, 1)), 0, 1).mean())

    def score(self, row):
        x, now = self.when(row)
        return (self._score(np.take_along_axis(self.counts, self._cells(x), 2)[..., 0] * self._faded(now)),)

    def step(self, row):
        x, now = self.when(row)
        at = self._cells(x)
        self.counts *= self._faded(now)
        self.last = self.newest = now
        held = np.take_along_axis(self.counts, at, 2)[..., 0]
        score = self._score(held)
        np.put_along_axis(self.counts, at, held[..., None] + 1, 2)
        self.n += 1
        gap = x - self.mean
        self.mean = self.mean + gap / self.n
        self.m2 = self.m2 + gap * (x - self.mean)
        return (score,)


class Loda(Kernel):
    """Mean negative log density over histograms of projections, whose counts fade by decay at each row.

    matrix: a row for each projection, as operators.trees.loda_matrix makes it. The plan
    operators.trees.loda gives the same without decay.
    """

    def __init__(self, matrix, n_bins=32, warm_up=256, decay=1.0, pseudocount=1.0, eps=1e-12):
        if not 0 < decay <= 1:
            raise ValueError("decay must be above 0 and at most 1")
        self.matrix, self.bins, self.warm, self.decay = np.asarray(matrix, float), n_bins, warm_up, decay
        self.pseudo, self.eps, self.n = pseudocount, eps, 0
        self.first: list[np.ndarray] = []
        self.every = np.arange(len(self.matrix))

    def info(self):
        return {"n_samples_seen": [float(self.n)], "is_ready": [float(self.n >= self.warm)]}

    def _bin(self, z: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((z - self.low) / self.step_of), 0, self.bins - 1).astype(int)

    def _fit(self) -> None:
        z = np.array(self.first)
        low, high = z.min(0), z.max(0)
        flat = high - low <= self.eps
        self.low = np.where(flat, low - 0.5, low)
        self.step_of = (np.where(flat, high + 0.5, high) - self.low) / self.bins
        self.counts, self.total, self.first = np.zeros((len(z.T), self.bins)), float(len(z)), []
        for one in z:
            self.counts[self.every, self._bin(one)] += 1

    def _projected(self, row: tuple) -> np.ndarray:
        z = np.zeros(len(self.matrix))
        for weights, x in zip(self.matrix.T, row):  # in the order of features, so that bin edges fall alike everywhere
            z = z + weights * x
        return z

    def _score(self, at: np.ndarray) -> float:
        share = (self.counts[self.every, at] + self.pseudo) / (self.total + self.pseudo * self.bins)
        return max(0.0, float(-np.log(share / np.maximum(self.step_of, self.eps) + self.eps).mean()))

    def score(self, row):
        return (0.0 if self.n < self.warm else self._score(self._bin(self._projected(row))),)

    def step(self, row):
        z = self._projected(row)
        score = 0.0
        if self.n < self.warm:
            self.first.append(z)
            if len(self.first) == self.warm:
                self._fit()
        else:
            at = self._bin(z)
            score = self._score(at)
            self.counts *= self.decay
            self.counts[self.every, at] += 1
            self.total = self.total * self.decay + 1
        self.n += 1
        return (score,)


class XStream(Kernel):
    """Half-space chains over a sparse projection; bins of the last full window are counted exactly."""

    def __init__(self, names=("x",), k=100, chains=100, depth=15, window=256, init=256, density=1 / 3, seed=1):
        self.rng = np.random.default_rng(seed)
        self.project = np.zeros((len(names), k))
        for i, name in enumerate(names):
            own = np.random.default_rng([seed, *hashlib.sha256(name.encode()).digest()[:8]])
            at = own.choice(k, max(1, round(k * density)), replace=False)
            self.project[i, at] = own.choice([-1.0, 1.0], len(at))
        self.dims = self.rng.integers(0, k, (chains, depth))
        self.unit_shift = self.rng.random((chains, k))
        self.window, self.init, self.first = window, init, []
        self.half, self.now, self.before, self.n = None, defaultdict(int), None, 0

    def _bins(self, y: np.ndarray):
        """For each chain, the key of the row's cell at each level."""
        for c, dims in enumerate(self.dims):
            z: dict[int, float] = {}
            for level, f in enumerate(dims.tolist()):
                s = self.unit_shift[c, f]
                z[f] = 2 * z[f] - s if f in z else y[f] / self.half[f] + s
                yield c, level, (c, level, *sorted((g, math.floor(v)) for g, v in z.items()))

    def _learn(self, y: np.ndarray) -> None:
        for *_, key in self._bins(y):
            self.now[key] += 1
        self.n += 1
        if self.n == self.window:
            self.before, self.now, self.n = self.now, defaultdict(int), 0

    def score(self, row):
        return (self._score(np.array(row, float) @ self.project),)

    def _score(self, y: np.ndarray) -> float:
        if self.before is None:
            return 0.0
        least = [math.inf] * len(self.dims)
        for c, level, key in self._bins(y):
            least[c] = min(least[c], math.log2(1 + self.before.get(key, 0)) + level + 1)
        return min(1.0, max(0.0, float(np.mean(2.0 ** (1 - np.array(least))))))

    def step(self, row):
        y = np.array(row, float) @ self.project
        score = self._score(y)
        if self.half is None:
            self.first.append(y)
            if len(self.first) == self.init:
                span = np.ptp(np.array(self.first), axis=0) / 2
                self.half = np.where(span > 0, span, 1.0)
                for one in self.first:
                    self._learn(one)
                self.first = []
        else:
            self._learn(y)
        return (score,)


class AnoEdge(Kernel):
    """Density around an edge's cell in hashed adjacency matrices; rows are (src, dst)."""

    def __init__(self, rows=256, cols=256, hashes=4, radius=2, decay=1.0, warm_up=128, seed=1, eps=1e-9, normalize=False):
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.integers(1, PRIME, (2, hashes)), rng.integers(0, PRIME, (2, hashes))
        self.m = np.zeros((hashes, rows, cols))
        self.radius, self.decay, self.warm, self.eps, self.normalize = radius, decay, warm_up, eps, normalize
        self.n, self.t = 0, None

    def twin(self, n: int = 0, counts: np.ndarray | None = None):
        """n, counts: rows learned, and how often each cell came among them."""
        if type(self) is AnoEdge and not self.n:
            head = struct.pack("<4iqi2d", *self.m.shape[1:], len(self.m), self.radius, self.warm, self.normalize, self.decay, self.eps)
            held = b"" if counts is None else counts.astype("<i8").tobytes()
            return "anoedge", head + self.a.astype("<i8").tobytes() + self.b.astype("<i8").tobytes() + struct.pack("<q", n) + held

    def _faded(self, t: list) -> float:
        return self.decay ** (t[0] - self.t) if t and self.t is not None and t[0] > self.t else 1.0

    def _cells(self, src: float, dst: float) -> list[tuple[int, int]]:
        """The edge's cell in each matrix."""
        at = [((self.a[i] * (int(v) % PRIME) + self.b[i]) % PRIME) % self.m.shape[i + 1] for i, v in enumerate((src, dst))]
        return list(zip(*at))

    def score(self, row):
        src, dst, *t = row
        fade = self._faded(t)
        return self._score(self._cells(src, dst), self.m if fade == 1.0 else self.m * fade)

    def _score(self, cells: list[tuple[int, int]], every: np.ndarray) -> tuple:
        scores = []
        for m, (i, j) in zip(every, cells if self.n >= self.warm else []):
            r = self.radius
            near = m[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]
            total, across, down = m.sum(), m[i].sum() + 1, m[:, j].sum() + 1
            dense = (near.sum() + 1) / near.size / ((total + 1) / m.size + self.eps)
            rare = across * down / (total + 1) / (m[i, j] + 1 + self.eps)
            scores.append(math.log1p(dense) * math.log1p(rare) + 1 / math.sqrt(across * down))
        score = float(np.median(scores)) if scores else 0.0
        return (score / (1 + score) if self.normalize else score,)

    def step(self, row):
        src, dst, *t = row
        if self._faded(t) != 1.0:
            self.m *= self._faded(t)
        self.t = t[0] if t else None
        cells = self._cells(src, dst)
        out = self._score(cells, self.m)
        for m, (i, j) in zip(self.m, cells):
            m[i, j] += 1
        self.n += 1
        return out


class StreamSpot(Kernel):
    """Signed shingle sketches of graphs against online cluster centres; rows are (graph, src, dst, type)."""

    def __init__(self, dim=1024, shingle=2, clusters=8, max_graphs=4096, warm_up=32, seed=1, eps=1e-9, normalize=False):
        self.dim, self.shingle, self.k, self.most, self.warm = dim, shingle, clusters, max_graphs, warm_up
        self.key = int(seed).to_bytes(8, "little", signed=True)
        self.eps, self.normalize = eps, normalize
        self.graphs: OrderedDict[float, tuple[np.ndarray, deque]] = OrderedDict()
        self.centres, self.weights = np.zeros((0, dim)), []

    def _slot(self, parts: tuple) -> tuple[int, float]:
        h = int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=9, key=self.key).digest(), "little")
        return (h >> 8) % self.dim, 1.0 if h % 2 == 0 else -1.0

    def score(self, row):
        return self._asked(row)[0]

    def _asked(self, row: tuple) -> tuple[tuple, np.ndarray, deque]:
        """The score, the graph's sketch with the edge, and the edges before it."""
        graph, edge = row[0], tuple(row[1:])
        known = self.graphs.get(graph)
        sketch, tail = known or (np.zeros(self.dim), deque(maxlen=self.shingle - 1))
        slot = self._slot((*tail, edge)) if len(tail) == self.shingle - 1 else None
        new = sketch.copy()
        novelty = 0.0
        if slot:
            novelty = 1 / (max(sketch[slot[0]] * slot[1], 0.0) + 1)
            new[slot[0]] += slot[1]
        score = 0.0
        if len(self.graphs) >= self.warm and len(self.centres):
            d = math.sqrt(float(((self.centres - new) ** 2).sum(1).min()))
            score = d / (1 + d + self.eps) + novelty
        return (score / (1 + score) if self.normalize else score,), new, tail

    def step(self, row):
        graph, edge = row[0], tuple(row[1:])
        out, new, tail = self._asked(row)
        if len(self.centres) < self.k:
            self.centres = np.vstack((self.centres, new))
            self.weights.append(1.0)
        else:
            c = int(((self.centres - new) ** 2).sum(1).argmin())
            self.weights[c] += 1
            self.centres[c] += (new - self.centres[c]) / self.weights[c]
        tail.append(edge)
        self.graphs[graph] = (new, tail)
        self.graphs.move_to_end(graph)
        if len(self.graphs) > self.most:
            self.graphs.popitem(last=False)
        return out


class AdaptiveSvm(Kernel):
    """One-class machine with Gaussian kernels on a budget of vectors; the width follows recent data."""

    outputs = "score double, label int"

    def __init__(self, nu=0.1, gamma=1.0, bounds=(0.001, 100.0), rate=0.1, buffer=200, budget=100, tolerance=1e-6, seed=1):
        self.nu, self.gamma, self.bounds, self.rate, self.budget, self.tol = nu, gamma, bounds, rate, budget, tolerance
        self.rng = np.random.default_rng(seed)
        self.recent: deque = deque(maxlen=buffer)
        self.sv, self.alpha, self.born = np.zeros((0, 0)), np.zeros(0), np.zeros(0)
        self.rho, self.n, self.mean, self.std = 0.0, 0, None, None

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * ((a[:, None] - b[None]) ** 2).sum(2))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.std > 0, (x - self.mean) / (self.std + 1e-8), x)

    def _decide(self, z: np.ndarray) -> float:
        return float(self._kernel(z[None], self.sv)[0] @ self.alpha - self.rho)

    def _centre(self) -> None:
        self.rho = float(np.median(self._kernel(self.sv, self.sv) @ self.alpha))

    def _take(self, z: np.ndarray, alpha: float) -> None:
        self.sv = np.vstack((self.sv, z)) if len(self.sv) else z[None]
        self.alpha, self.born = np.append(self.alpha, alpha), np.append(self.born, self.n)
        if len(self.sv) > self.budget:
            age = self.n - self.born
            out = int((0.4 * (1 - self.alpha / (self.alpha.max() + 1e-8)) + 0.6 * age / (age.max() + 1e-8)).argmax())
            keep = np.arange(len(self.sv)) != out
            self.sv, self.alpha, self.born = self.sv[keep], self.alpha[keep], self.born[keep]
        self._centre()

    def info(self):
        return {
            "n_support_vectors": [float(len(self.sv))], "gamma": [float(self.gamma)], "rho": [float(self.rho)],
            "n_samples_processed": [float(self.n)], "buffer_size": [float(len(self.recent))], "sv_ages": (self.n - self.born).tolist(),
        }

    def _adapt(self) -> None:
        rows = np.array(self.recent)
        if self.n % 20 or len(rows) < 10:
            return
        rows = (rows - rows.mean(0)) / (rows.std(0) + 1e-8)
        some = rows[self.rng.choice(len(rows), min(50, len(rows)), replace=False)]
        gaps = [np.linalg.norm(some[i] - some[j]) for i in range(len(some)) for j in range(i + 1, min(i + 10, len(some)))]
        gaps = [g for g in gaps if g > 1e-10]
        if not gaps:
            return
        aim = float(np.clip(1 / (2 * np.median(gaps) ** 2), *self.bounds))
        if abs(aim - self.gamma) > 0.01 * self.gamma:
            self.gamma = float(np.clip(self.gamma + self.rate * (aim - self.gamma), *self.bounds))
            self._centre()

    def score(self, row):
        if not len(self.sv):
            return 0.0, 1
        f = self._decide(self._scaled(np.array(row, float)))
        return -f, 1 if f >= -self.tol else -1

    def step(self, row):
        x = np.array(row, float)
        out = self.score(row)
        if self.mean is None:
            self.mean, self.std = x.copy(), np.ones_like(x)
        else:
            old = self.mean
            self.mean = old + (x - old) / (self.n + 1)
            self.std = np.sqrt((self.n * self.std**2 + (x - old) * (x - self.mean)) / (self.n + 1))
        z = self._scaled(x)
        self.n += 1
        self.recent.append(z)
        if not len(self.sv):
            self._take(z, 1 / (self.nu * 10))
            return out
        f = self._decide(z)
        if f < -self.tol:
            self._take(z, min(-f, 1 / self.nu))
        self._adapt()
        return out


def _soft(gap: np.ndarray) -> np.ndarray:
    return np.where(np.abs(gap) < 1, gap * gap / 2, np.abs(gap) - 0.5)


#: For each loss, a value of each gap (their mean is the loss) and the slope of it.
LOSSES = {
    "mse": (np.square, lambda gap: 2 * gap),
    "rmse": (np.square, lambda gap: gap),
    "l1": (np.abs, np.sign),
    "smooth_l1": (_soft, lambda gap: np.clip(gap, -1, 1)),
    "huber": (_soft, lambda gap: np.clip(gap, -1, 1)),
}


class Net:
    """Dense layers with one activation between them, trained on one row at a time."""

    def __init__(self, sizes: list[int], rng: np.random.Generator, activation: str = "relu", rate: float = 0.01):
        self.w = [rng.uniform(-1, 1, (b, a)) * math.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(n) for n in sizes[1:]]
        self.tanh, self.rate = activation == "tanh", rate

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            z = w @ out[-1] + b
            out.append(z if i == len(self.w) - 1 else np.tanh(z) if self.tanh else np.maximum(z, 0))
        return out

    def loss(self, x: np.ndarray, kind: str | tuple = "mse", learn: bool = False) -> float:
        acts = self._forward(x)
        gap = acts[-1] - x
        of, by = LOSSES[kind] if isinstance(kind, str) else kind
        value = of(gap).mean()
        if learn:
            slope = by(gap) / len(x)
            for i in range(len(self.w) - 1, -1, -1):
                back = self.w[i].T @ slope
                self.w[i] = self.w[i] - self.rate * np.outer(slope, acts[i])
                self.b[i] = self.b[i] - self.rate * slope
                if i:
                    slope = back * (1 - acts[i] ** 2 if self.tanh else acts[i] > 0)
        return float(math.sqrt(value) if kind == "rmse" else value)


class Autoencoder(Kernel):
    """Reconstruction loss of a network that learns each row by one gradient step.

    loss: a name in LOSSES, or functions of the gaps as there. net: anything with
    Net's loss(x, kind, learn), in place of dense layers.
    """

    def __init__(self, n_features=1, hidden=(64, 32, 16, 32, 64), loss="mse", rate=0.01, seed=1, net=None):
        if isinstance(loss, str) and loss not in LOSSES:
            raise ValueError(f"unknown loss {loss!r}")
        self.net = net or Net([n_features, *hidden, n_features], np.random.default_rng(seed), "relu", rate)
        self.kind = loss

    def score(self, row):
        return (self.net.loss(np.array(row, float), self.kind, learn=False),)

    def step(self, row):
        x = np.array(row, float)
        return (self.net.loss(x, self.kind, learn=True),)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class _FirstStep:
    """An LSTM layer on a sequence of one row: with zero state before it, the forget gate and recurrent weights play no part."""

    def __init__(self, n: int, hidden: int, rng: np.random.Generator):
        self.w = rng.uniform(-1, 1, (3, hidden, n)) / math.sqrt(hidden)  # input, candidate, output
        self.b = rng.uniform(-1, 1, (3, hidden)) / math.sqrt(hidden)

    def forward(self, x: np.ndarray) -> np.ndarray:
        z = self.w @ x + self.b
        self.x, self.i, self.g, self.o = x, _squash(z[0]), np.tanh(z[1]), _squash(z[2])
        self.c = np.tanh(self.i * self.g)
        return self.o * self.c

    def learn(self, slope: np.ndarray, rate: float) -> np.ndarray:
        """One step down the loss; returns the slope by the layer's input."""
        cell = slope * self.o * (1 - self.c**2)
        z = np.stack([cell * self.g * self.i * (1 - self.i), cell * self.i * (1 - self.g**2), slope * self.c * self.o * (1 - self.o)])
        back = np.einsum("khn,kh->n", self.w, z)
        self.w = self.w - rate * z[:, :, None] * self.x
        self.b = self.b - rate * z
        return back


class LstmAutoencoder(Kernel):
    """Mean squared error of a recurrent encoder and decoder around a dense bottleneck; each row is a sequence of its own."""

    def __init__(self, n_features=1, hidden=64, latent=16, rate=0.01, seed=1):
        rng = np.random.default_rng(seed)
        self.encoder, self.decoder = _FirstStep(n_features, hidden, rng), _FirstStep(hidden, n_features, rng)
        self.w = [rng.uniform(-1, 1, (b, a)) / math.sqrt(a) for a, b in ((hidden, latent), (latent, hidden))]
        self.b = [np.zeros(latent), np.zeros(hidden)]
        self.rate = rate

    def loss(self, x: np.ndarray, learn: bool = False) -> float:
        h = self.encoder.forward(x)
        z = self.w[0] @ h + self.b[0]
        gap = self.decoder.forward(self.w[1] @ z + self.b[1]) - x
        if learn:
            slope = self.decoder.learn(2 * gap / len(x), self.rate)
            for k, given in ((1, z), (0, h)):
                back = self.w[k].T @ slope
                self.w[k] = self.w[k] - self.rate * np.outer(slope, given)
                self.b[k] = self.b[k] - self.rate * slope
                slope = back
            self.encoder.learn(slope, self.rate)
        return float((gap * gap).mean())

    def score(self, row):
        return (self.loss(np.array(row, float)),)

    def step(self, row):
        return (self.loss(np.array(row, float), learn=True),)


class KitNet(Kernel):
    """Small autoencoders over correlated feature groups, and one over their errors."""

    outputs = "score double, phase string"

    def __init__(self, max_group=10, map_grace=5000, train_grace=50_000, rate=0.1, hidden=0.75, adaptive=False, seed=1):
        self.most, self.map, self.train, self.rate, self.ratio, self.adaptive = max_group, map_grace, train_grace, rate, hidden, adaptive
        self.rng = np.random.default_rng(seed)
        self.n, self.sums, self.groups, self.nets, self.top = 0, None, None, [], None

    def _groups(self, cov: np.ndarray) -> list[np.ndarray]:
        sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
        near = np.abs(cov / np.outer(sd, sd))
        np.fill_diagonal(near, 1.0)
        if len(near) <= self.most:
            return [np.arange(len(near))]
        strong, free, out = near.sum(1), list(range(len(near))), []
        while free:
            group = [max(free, key=lambda i: strong[i])]
            free.remove(group[0])
            while free and len(group) < self.most:
                group.append(max(free, key=lambda i: near[i, group].mean()))
                free.remove(group[-1])
            out.append(np.sort(group))
        return out

    def _net(self, n: int) -> Net:
        width = 1 if n <= 1 else min(max(1, math.ceil(n * self.ratio)), n - 1)
        return Net([n, width, n], self.rng, "tanh", self.rate)

    def _errors(self, x: np.ndarray, learn: bool) -> np.ndarray:
        return np.array([net.loss(x[g], "rmse", learn) for g, net in zip(self.groups, self.nets)])

    def score(self, row):
        ready = self.n >= self.map + self.train
        score = self.top.loss(self._errors(np.array(row, float), False), "rmse") if ready else 0.0
        return max(0.0, score), "ready" if ready else "detector" if self.n >= self.map else "feature_map"

    def step(self, row):
        x = np.array(row, float)
        out = self.score(row)
        if self.n < self.map:
            s = np.append(x, 1.0)
            self.sums = np.outer(s, s) if self.sums is None else self.sums + np.outer(s, s)
            if self.n + 1 == self.map:
                mean = self.sums[-1, :-1] / self.map
                self.groups = self._groups(self.sums[:-1, :-1] / self.map - np.outer(mean, mean))
                self.nets = [self._net(len(g)) for g in self.groups]
                self.top = self._net(len(self.groups))
        elif self.adaptive or self.n < self.map + self.train:
            self.top.loss(self._errors(x, True), "rmse", learn=True)
        self.n += 1
        return out
