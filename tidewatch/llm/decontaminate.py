"""Benchmark decontamination: whole-text window scans against a hash set of test n-grams.

A window is ``size`` consecutive normalised words of a benchmark item; an item
with fewer words, but some, is one window. A document's words are hashed once,
window hashes are looked up in the benchmark's sorted hash set, and each hit is
verified word for word. The set is broadcast only if the benchmark's words fit
``broadcast_words``; a larger benchmark is scanned for in blocks of that size,
dealt by item, whose results are merged by id and text; as equal rows have equal
results, each row of the input keeps its own either way.

Defined results: null, empty and wordless texts have no words and no hits; very
long texts are scanned whole; an empty benchmark hits nothing and an empty table
gives no rows; an item with a null id can hit words but is not listed; repeated items count once;
repeated document rows give repeated results; other columns, whatever
their names, are ignored by the query and kept by ``remove`` and ``remove_spans``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, small_batches, table

#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest separates.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
PRIME = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * np.uint64(PRIME)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Benchmark windows by length: sorted hashes, and the windows behind each."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        hashes = Hashes()
        made: dict[int, dict[int, dict[tuple[bytes, ...], set]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(size, len(words))
            rolled = _rolled(np.fromiter((hashes[w] for w in words), np.uint64, len(words)), width)
            at = made.setdefault(width, {})
            for i, h in enumerate(rolled.tolist()):
                at.setdefault(h, {}).setdefault(tuple(words[i : i + width]), set()).add(item)
        self.widths = {w: (np.array(sorted(at), np.uint64), at) for w, at in sorted(made.items())}

    def hits(self, words: list[bytes], hashes: Hashes) -> tuple[list[tuple[int, int]], set]:
        """Merged word intervals that windows cover, and the items they are of."""
        n = len(words)
        marked, items = np.zeros(n + 1, np.int64), set()
        h = np.fromiter((hashes[w] for w in words), np.uint64, n)
        for width, (keys, at) in self.widths.items():
            if n < width:
                continue
            rolled = _rolled(h, width)
            place = np.minimum(np.searchsorted(keys, rolled), len(keys) - 1)
            for i in np.flatnonzero(keys[place] == rolled).tolist():
                found = at[int(rolled[i])].get(tuple(words[i : i + width]))
                if found:
                    items |= found
                    marked[i] += 1
                    marked[i + width] -= 1
        inside = np.concatenate(([False], np.cumsum(marked)[:n] > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist())), items


def _row(index: Broadcast) -> Callable:
    def make():
        hashes, known = Hashes(), index.value

        def row(doc_id, text, *key):
            words = words_of(text)
            spans, items = known.hits(words, hashes) if words else ([], set())
            hits = [{"start": a, "end": b} for a, b in spans]
            return doc_id, len(words), hits, sorted(str(x) for x in items if x is not None), *key

        return row

    return make


SCANNED = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def scan(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, broadcast_words: int = 4_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, hits (merged intervals of word positions), items (ids as sorted text)."""
    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    bench = benchmark.select("item_id", "text").distinct()
    blocks = _blocks_of(bench, broadcast_words)
    if blocks == 1:
        return _against(rows, bench, size, SCANNED)
    merged = _in_blocks(rows, bench, size, blocks)
    return merged.withColumn("_row", F.explode(F.sequence(F.lit(1), "n_rows"))).select("doc_id", "n_words", "hits", "items")


def _against(rows: DataFrame, bench: DataFrame, size: int, schema: str) -> DataFrame:
    index = Index([tuple(r) for r in bench.select("item_id", "text").collect()], size)
    return map_rows(rows, _row(rows.sparkSession.sparkContext.broadcast(index)), schema)


def _key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _in_blocks(rows: DataFrame, bench: DataFrame, size: int, blocks: int) -> DataFrame:
    """Merged results of an id and a text, the text's key, and n_rows: the rows of the input that have both."""
    bench = bench.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    keyed = rows.withColumn("key", _key("text"))
    parts = [_against(keyed, bench.where(F.col("_block") == k), size, SCANNED + ", key string") for k in range(blocks)]
    return _merged(parts)


def _blocks_of(bench: DataFrame, broadcast_words: int) -> int:
    """Blocks of the benchmark that have about broadcast_words words at most."""
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // (2 * broadcast_words)))  # a word takes two characters with its separator at least


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Results of blocks as one: hits and items of an id and a text are united; each part has every row once."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    united = """aggregate(array_sort(flatten(collect_set(hits))), cast(array() as array<struct<start:long,end:long>>),
        (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).end >= x.start,
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
                'end', greatest(element_at(acc, -1).end, x.end)))),
            concat(acc, array(x))))"""
    return every.groupBy("doc_id", "key", "n_words").agg(
        (F.count("*") / len(parts)).cast("int").alias("n_rows"),
        F.expr(united).alias("hits"),
        F.expr("array_sort(array_distinct(flatten(collect_set(items))))").alias("items"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(hits, 0L, (acc, x) -> acc + x.end - x.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, size: int = 8, broadcast_words: int = 4_000_000) -> DataFrame:
    """docs without the rows of which benchmark windows hit ``size`` consecutive words or more.

    Items shorter than a window can't remove a document by themselves. A benchmark
    that is broadcast filters rows where they are; one in blocks by an anti-join on
    the text's key, so both decide by the row's own text.
    """
    bench = benchmark.select("item_id", "text").distinct()
    if (blocks := _blocks_of(bench, broadcast_words)) > 1:
        found = _in_blocks(docs.select("doc_id", "text"), bench, size, blocks)
        hit = found.where(F.exists("hits", lambda h: h["end"] - h["start"] >= size)).select(F.col("key").alias("_tw_bad")).distinct()
        return docs.join(hit, _key("text") == F.col("_tw_bad"), "left_anti")
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in bench.collect()], size))
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, known = Hashes(), index.value
        for texts in batches:
            found = (known.hits(words, hashes)[0] if (words := words_of(t)) else [] for t in texts)
            yield pd.Series([all(b - a < size for a, b in spans) for spans in found], dtype=bool)

    return docs.where(clean("text"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 8, broadcast_words: int = 4_000_000) -> DataFrame:
    """docs with the words that windows hit cut out of the text, and the separators between them.

    Every row is cut by the hits of its own text, whatever its id; a null text stays null.
    """
    bench = benchmark.select("item_id", "text").distinct()
    small_batches(docs.sparkSession)
    if (blocks := _blocks_of(bench, broadcast_words)) > 1:
        found = _in_blocks(docs.select("doc_id", "text"), bench, size, blocks).where(F.size("hits") > 0)
        found = found.groupBy(F.col("key").alias("_tw_key")).agg(F.first("hits").alias("_tw_hits"))  # equal texts have equal hits

        @F.pandas_udf("string")
        def cut_at(texts: pd.Series, hits: pd.Series) -> pd.Series:
            return pd.Series([_cut(t, h) for t, h in zip(texts, hits)], dtype=object)

        both = docs.join(found, _key("text") == F.col("_tw_key"), "left")
        text = F.when(F.col("_tw_hits").isNull(), F.col("text")).otherwise(cut_at("text", "_tw_hits"))
        return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in bench.collect()], size))

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, known = Hashes(), index.value
        for texts in batches:
            hits = ([{"start": a, "end": b} for a, b in known.hits(words, hashes)[0]] if (words := words_of(t)) else [] for t in texts)
            yield pd.Series([_cut(t, h) for t, h in zip(texts, hits)], dtype=object)

    return docs.select(*[cut("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _cut(text: str | None, hits) -> str | None:
    if text is None or hits is None or not len(hits):
        return text
    raw = text.encode()
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    out, last = [], 0
    for h in hits:
        out.append(raw[last : at[h["start"]][0]])
        last = at[h["end"] - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
