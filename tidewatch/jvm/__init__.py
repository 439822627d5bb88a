"""Ordered folds in the JVM: kernels that have a twin in Fold.java, called as a function over sorted partitions.

The driver compiles the source with Janino, which Spark itself uses, and hands the
classes to executors as a jar. The function keeps its state from row to row of a task,
so it isn't deterministic, and no rule may move or repeat it.
"""

from __future__ import annotations

import os
import pkgutil
import struct
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's functions have as many arguments at most.
MOST = 22
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_KEYS = (*_NUMBERS, T.StringType, T.BooleanType, T.DateType, T.TimestampType)
_loaded: dict = {}


def _calls() -> str:
    """A class for each number of arguments."""
    made = []
    for n in range(1, MOST + 1):
        kinds, given = ", ".join(["Object"] * (n + 1)), ", ".join(f"Object a{i}" for i in range(n))
        made.append(
            f"class Fold{n} extends Fold implements org.apache.spark.sql.api.java.UDF{n}<{kinds}> {{\n"
            "  public Fold%d(String kind, int keys, int width, boolean learnFirst, int stride, byte[] packed) { super(kind, keys, width, learnFirst, stride, packed); }\n" % n
            + f"  public Object call({given}) throws Exception {{ return run(new Object[] {{{', '.join(f'a{i}' for i in range(n))}}}); }}\n}}"
        )
    return "\n".join(made).replace("class Fold", "public class Fold")


def _loader(spark):
    """A class loader of this application's folds; executors have them from then on."""
    jvm, context = spark._jvm, spark.sparkContext
    app = context.applicationId
    if app not in _loaded:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data(__name__, "Fold.java").decode() + _calls())
        path = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), f"folds-{app}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.sc().addJar(path)
        _loaded.clear()
        _loaded[app] = compiler.getClassLoader()
    return _loaded[app]


def fits(df: DataFrame, keys: list[str], features: list[str]) -> bool:
    """Whether columns are of types, and so few, that the JVM's folds take them."""
    if not hasattr(df.sparkSession, "_jvm") or not features or len(keys) + len(features) > MOST or df.isStreaming:
        return False
    kinds = df.schema
    return all(isinstance(kinds[c].dataType, _KEYS) for c in keys) and all(isinstance(kinds[c].dataType, _NUMBERS) for c in features)


def answer(df: DataFrame, keys: list[str], features: list[str], twins: list[tuple[str, bytes]], learn_first: bool = False, stride: int = 0) -> Column:
    """What the kernels say, in the mean, of each row of a frame that is sorted by keys and order within partitions.

    twins: name and state of each, as ``Kernel.twin`` gives them. stride: if not 0, the
    last key is the first kernel that a key has, and this the way to its next.
    """
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    spark = df.sparkSession
    jvm = spark._jvm
    packed = struct.pack("<i", len(twins)) + b"".join(struct.pack("<i", len(state)) + state for _, state in twins)
    of = _loader(spark).loadClass(f"tidewatch.Fold{len(keys) + len(features)}").getConstructors()[0]
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 6)
    for i, v in enumerate((twins[0][0], len(keys), len(features), learn_first, stride, packed)):
        args[i] = v
    function = getattr(jvm.org.apache.spark.sql, "functions").udf(of.newInstance(args), jvm.org.apache.spark.sql.types.DataType.fromJson('"double"'))
    columns = _to_seq(spark.sparkContext, [F.col(c) for c in (*keys, *features)], _to_java_column)
    return Classic(function.asNondeterministic().apply(columns))
