"""What the text operators share: table access, shared-folder tables, Arrow maps, spans."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a temporary folder.
    A cluster without it is refused, as a machine-local folder would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    made = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tidewatch-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back. The path is in ``df.scratch_path``."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        back = self.spark.read.parquet(path)
        back.scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Lets a semi-join drop rows of the large side by a Bloom filter before they are shuffled.
#: The filter's bits are bounded by Spark (spark.sql.optimizer.runtime.bloomFilter.maxNumBits).
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "16g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows of whole texts are large: Arrow batches of the session get this many at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., tuple]],
    schema: str,
) -> DataFrame:
    """One output tuple for each input row, in Arrow batches.

    make() runs once a task and returns the row function, which may hold caches.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = [row(*values) for values in zip(*columns)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def join_spans(spans: Iterable[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """Spans (start, end, kind) as ``kind:start:end``, by start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    ordered = sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc_fold(column: str, parts: int) -> Column:
    """crc32 of a column's text, modulo parts; null stays null."""
    return F.expr(f"crc32(cast(`{column}` as string)) % {int(parts)}")
