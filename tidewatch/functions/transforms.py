"""Transformers as kernels, and chains of them before a detector."""

from __future__ import annotations

import struct

import numpy as np

from tidewatch.functions.kernels import Kernel, Lof, Transformer
from tidewatch.operators.simple import projection_matrix


class _Columns(Transformer):
    def __init__(self, n_features: int):
        self.n = 0
        self.outputs = ", ".join(f"scaled_{i} double" for i in range(n_features))


class MinMaxScaler(_Columns):
    """Each feature over the range seen so far; a range of one value gives the lower bound."""

    def __init__(self, n_features=1, low=0.0, high=1.0):
        if low >= high:
            raise ValueError("the range needs a lower and a higher bound")
        super().__init__(n_features)
        self.low, self.high = low, high
        self.least, self.most = np.full(n_features, np.inf), np.full(n_features, -np.inf)

    def transform(self, row):
        if not self.n:
            return (None,) * len(row)
        span = self.most - self.least
        share = np.where(span > 0, (np.array(row, float) - self.least) / np.where(span > 0, span, 1), 0)
        return tuple((self.low + share * (self.high - self.low)).tolist())

    def learn(self, row):
        self.n += 1
        self.least, self.most = np.minimum(self.least, row), np.maximum(self.most, row)


class StandardScaler(_Columns):
    """Each feature centred, over its population deviation; no deviation gives 0."""

    def __init__(self, n_features=1, with_std=True):
        super().__init__(n_features)
        self.with_std = with_std
        self.mean, self.spread = np.zeros(n_features), np.zeros(n_features)

    def transform(self, row):
        if not self.n:
            return (None,) * len(row)
        gap = np.array(row, float) - self.mean
        if self.with_std:
            deviation = np.sqrt(self.spread / self.n)
            gap = np.where(deviation > 0, gap / np.where(deviation > 0, deviation, 1), 0.0)
        return tuple(gap.tolist())

    def learn(self, row):
        self.n += 1
        gap = np.array(row, float) - self.mean
        self.mean = self.mean + gap / self.n
        self.spread = self.spread + gap * (np.array(row, float) - self.mean)


class RandomProjection(Transformer):
    """A fixed sparse projection; it learns nothing."""

    def __init__(self, n_features=1, n_components=1, seed=1):
        self.matrix = projection_matrix(n_features, n_components, seed)
        self.outputs = ", ".join(f"component_{i} double" for i in range(n_components))

    def transform(self, row):
        return tuple((np.array(row, float) @ self.matrix).tolist())

    def learn(self, row):
        pass


class Chain(Transformer):
    """Transformers, then a detector or one transformer more.

    A row is scored as the transformers see it before they learn it, and learned by
    each part as the parts before it see it afterwards. Nulls of an unlearned scaler
    give null outputs.
    """

    def __init__(self, *parts: Kernel):
        flat = [p for part in parts for p in (part.parts if isinstance(part, Chain) else [part])]
        if len(flat) < 2 or not all(isinstance(p, Transformer) for p in flat[:-1]):
            raise ValueError("a chain is one or more transformers and a last part")
        self.parts = flat
        self.outputs = flat[-1].outputs

    def twin(self):
        scaler, last = self.parts[0], self.parts[-1]
        if len(self.parts) == 2 and type(scaler) is StandardScaler and not scaler.n and type(last) is Lof and last.twin():
            return "lof", last.twin()[1][:-4] + struct.pack("<i", 1 + bool(scaler.with_std))

    def _asked(self, row: tuple) -> tuple:
        for part in self.parts[:-1]:
            if None in row:
                break
            row = part.transform(row)
        return row

    def _learned(self, row: tuple) -> tuple:
        for part in self.parts[:-1]:
            part.learn(row)
            row = part.transform(row)
        return row

    def transform(self, row):
        if not isinstance(self.parts[-1], Transformer):
            raise TypeError("the last part is a detector, which scores")
        return self.score(row)

    def score(self, row):
        asked = self._asked(row)
        return self._nulls() if None in asked else self.parts[-1].score(asked)

    def learn(self, row):
        self.parts[-1].step(self._learned(row))

    def step(self, row):
        last = self.parts[-1]
        asked = self._asked(row)
        own = self._learned(row)
        if asked == own:
            return last.step(own)
        out = self._nulls() if None in asked else last.score(asked)
        last.step(own)
        return out

    def _nulls(self) -> tuple:
        return (None,) * (self.outputs.count(",") + 1)
