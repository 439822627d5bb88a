"""Labelled streams from NPZ bundles, and a catalogue of them in a folder.

A bundle holds features X (n x d) and labels y (n). Rows keep their position as
``seq``. NPZ is read on the driver, as the format isn't splittable; convert once
and read parquet afterwards.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import urllib.request
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.datasets import KNOWN, DatasetInfo


def _arrays(path: str, features: str, labels: str) -> tuple[np.ndarray, np.ndarray]:
    with np.load(path) as bundle:
        x, y = bundle[features], bundle[labels]
    if len(x) != len(y):
        raise ValueError(f"{len(x)} rows but {len(y)} labels")
    return np.asarray(x, float).reshape(len(y), -1), np.asarray(y)


def read_npz(spark: SparkSession, path: str, prefix: str = "feature_", label: str = "y", feature: str = "X", sanitize: bool = True) -> DataFrame:
    """seq, prefix0 .. prefix(d-1), label. sanitize: not-a-number becomes null."""
    x, y = _arrays(path, feature, label)
    pdf = pd.DataFrame(x, columns=[f"{prefix}{i}" for i in range(x.shape[1])])
    pdf.insert(0, "seq", np.arange(len(y)))
    pdf[label] = y.astype(np.int32)
    schema = ", ".join(["seq bigint", *[f"{c} double" for c in pdf.columns[1:-1]], f"{label} int"])
    df = spark.createDataFrame(pdf, schema)
    if sanitize:
        df = df.select("seq", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns[1:-1]], label)
    return df


def npz_to_parquet(spark: SparkSession, path: str, out: str, **how) -> None:
    read_npz(spark, path, **how).write.mode("overwrite").parquet(out)


def with_batches(df: DataFrame, size: int = 1000, seq: str = "seq") -> DataFrame:
    """Adds the number of each row's batch of size rows; the last is short."""
    if size < 1:
        raise ValueError("size must be at least 1")
    return df.withColumn("batch", F.expr(f"`{seq}` div {size}"))


class Catalogue:
    """Datasets of a folder: the well-known ones, unless its catalogue.json (a list of DatasetInfo fields) names others.

    origin: an address (http, https or file) that bundles are fetched from when they are
    not in the folder; none by default, so nothing is fetched unasked.
    """

    def __init__(self, folder: str, origin: str | None = None, tries: int = 3, wait: float = 1.0):
        self.folder, self.origin, self.tries, self.wait = Path(folder), origin, max(1, tries), max(0.0, wait)
        path = self.folder / "catalogue.json"
        own = [DatasetInfo(**x) for x in json.loads(path.read_text())] if path.exists() else KNOWN
        self.entries = {x.name: x for x in own}

    def info(self, name: str) -> DatasetInfo:
        if name not in self.entries:
            raise KeyError(f"unknown dataset {name!r}; there are {', '.join(sorted(self.entries)) or 'none'}")
        return self.entries[name]

    def available(self) -> list[str]:
        return sorted(self.entries)

    def categories(self) -> list[str]:
        return sorted({x.category for x in self.entries.values()})

    def by_category(self, category: str) -> list[str]:
        return sorted(x.name for x in self.entries.values() if x.category == category)

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "name string, filename string, description string, n_samples long, n_features long, anomaly_rate double, source string, category string, sha256 string"
        return spark.createDataFrame([tuple(vars(x).values()) for x in self.entries.values()], schema)

    def cached(self) -> list[str]:
        return [n for n in self.available() if (self.folder / self.entries[n].filename).exists()]

    def cached_bytes(self) -> int:
        return sum((self.folder / self.entries[n].filename).stat().st_size for n in self.cached())

    def _check(self, info: DatasetInfo, path: Path) -> Path:
        if info.sha256 and hashlib.sha256(path.read_bytes()).hexdigest() != info.sha256:
            raise ValueError(f"{path} does not have the digest in the catalogue")
        return path

    def path(self, name: str) -> Path:
        """Of a bundle that is there, or is fetched if there is an origin, and has the digest it should."""
        info = self.info(name)
        path = self.folder / info.filename
        if not path.exists():
            if self.origin is None:
                raise FileNotFoundError(path)
            return self.fetch(name)
        return self._check(info, path)

    def fetch(self, name: str, force: bool = False) -> Path:
        """A bundle from the origin, put in place only once it is whole and its digest is right.

        A failed try is made again after wait seconds, twice as long each time; a wrong
        digest is no failed try, and leaves nothing behind.
        """
        info = self.info(name)
        path = self.folder / info.filename
        if path.exists() and not force:
            return self._check(info, path)
        if self.origin is None:
            raise ValueError("there is no origin to fetch from")
        self.folder.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f"{path.name}.{os.getpid()}.part")
        try:
            for n in range(self.tries):
                try:
                    with urllib.request.urlopen(f"{self.origin.rstrip('/')}/{info.filename}", timeout=60) as given, part.open("wb") as taken:
                        shutil.copyfileobj(given, taken)
                    break
                except OSError as e:
                    if n + 1 == self.tries:
                        raise RuntimeError(f"{name} could not be fetched in {self.tries} tries") from e
                    time.sleep(self.wait * 2**n)
            return self._check(info, part).replace(path)
        finally:
            part.unlink(missing_ok=True)

    def load(self, spark: SparkSession, name: str, **how) -> DataFrame:
        return read_npz(spark, str(self.path(name)), **how)

    def clear(self, name: str | None = None) -> int:
        """Removes bundles; how many there were."""
        gone = [self.folder / self.entries[n].filename for n in self.cached() if name in (None, n)]
        for path in gone:
            path.unlink()
        return len(gone)


_default: list[Catalogue] = []


def set_cache_dir(folder: str, origin: str | None = None) -> Catalogue:
    """The folder that default_catalogue reads from now on."""
    _default[:] = [Catalogue(folder, origin)]
    return _default[0]


def default_catalogue() -> Catalogue:
    """The catalogue last set, else that of a cache folder in the user's home."""
    return _default[0] if _default else set_cache_dir(str(Path.home() / ".cache" / "tidewatch"))
