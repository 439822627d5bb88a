"""MinHash near-dedup with tensored banding.

Each document has a few small collections of ``rows`` minimum hashes. A table key
is made of a pair of collections, so m collections give m (m - 1) / 2 tables of
2 * rows hashes each: the hashes to compute are about the square root of those
that the tables hold. m is chosen so that two documents just at the threshold
share no table with a probability of at most ``miss``.

Documents with equal shingle sets form a class at once; one row of each class
goes on. Each bucket sends its members to a centre, pairs are confirmed on full
shingle sets, and components are formed. A bucket whose members then lie in
several components goes on: members of different components are compared by an
upper bound of their similarity that loses no link, and those that it joins form
a clump, each named by one row. Clumps that share members are united, and each
brings the texts of its members together once: there, full sets confirm links,
and only links that join two components are emitted, so a clump gives fewer
links than it has members. Comparisons run in blocks of bounded size inside
tasks; a group larger than a block is dealt over pairs of blocks. No step emits
the pairs of a bucket or a clump.

Shingle sets are compared as sets of 64-bit hashes.

Defined results: a null, empty or wordless text has no shingles and is linked
with nothing; a text with fewer words than a shingle is one shingle; a very long
text is taken whole, with a sketch in proportion to its length; a row with a null
id is its own document, without component, and is kept. An id is one document:
rows that repeat it with different texts link what any of these texts is similar
to, and each row is counted by its own text. Equal texts of different ids are
linked; ties in size change nothing. An empty table gives no rows. Other columns,
whatever their names, are ignored by the query and kept by ``deduplicate``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import BLOOM, Scratch, map_rows, settings, small_batches, table
from tidewatch.llm.components import components


@dataclass(frozen=True)
class Params:
    words: int = 3
    percent: int = 85
    rows: int = 2
    miss: float = 1e-5
    seed: int = 5
    block: int = 1500

    @property
    def collections(self) -> int:
        """Least m for which at most one of m collections agrees with a probability of miss or less."""
        p = (self.percent / 100) ** self.rows
        m = 3
        while sum(comb(m, k) * p**k * (1 - p) ** (m - k) for k in (0, 1)) > self.miss:
            m += 1
        return m


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out ^ h[k : k + n])
    return np.unique(out)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n, h1, h2 (digest of the set), c (a key for each collection), bins (shingles by bin)."""
    m = p.collections
    rng = np.random.default_rng(p.seed)
    mult = rng.integers(1, 1 << 63, m * p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def make():
        hashes = Hashes()

        def row(doc_id, text):
            s = shingles(text, p.words, hashes)
            if not len(s):
                return doc_id, 0, None, None, None, None
            lows = np.empty(m * p.rows, np.uint64)
            for a in range(0, len(s), 4096):
                part = _mix(s[None, a : a + 4096] * mult[:, None]).min(1)
                lows = part if a == 0 else np.minimum(lows, part)
            keys = np.zeros(m, np.uint64)
            for k in range(p.rows):
                keys = _mix(keys ^ lows[k::p.rows])
            digest = xxhash.xxh3_128_digest(s.tobytes())
            h1, h2 = np.frombuffer(digest, np.int64)
            width = max(7, len(s).bit_length() - 2)  # bits: 128 bins, and 4 to 8 shingles a bin in larger sets
            counts = np.bincount((s >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width)
            return doc_id, len(s), int(h1), int(h2), keys.view(np.int64).tolist(), counts.astype(np.uint16).tobytes()

        return row

    return map_rows(
        docs.select("doc_id", "text"), make, "doc_id long, n long, h1 long, h2 long, c array<long>, bins binary"
    )


def confirmed(pairs: DataFrame, docs: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """The pairs (a, b), written, whose full shingle sets are similar enough."""
    texts = texts_of(docs, pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), scratch)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        hashes = Hashes()
        known: dict[int, tuple[str, np.ndarray]] = {}

        def of(doc: int, text: str) -> np.ndarray:
            if doc not in known or known[doc][0] != text:
                if len(known) >= 64:
                    known.clear()
                known[doc] = (text, shingles(text, p.words, hashes))
            return known[doc][1]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = of(a, ta), of(b, tb)
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both_ >= p.percent * (len(x) + len(y) - both_))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    out = scratch.keep(both.mapInArrow(check, "a long, b long").distinct())
    scratch.drop(texts)
    return out


def _keys(m: int) -> str:
    return (
        f"flatten(transform(sequence(0, {m - 2}), i -> "
        f"transform(sequence(i + 1, {m - 1}), j -> xxhash64(i, j, c[i], c[j]))))"
    )


def _close(a: str, b: str, p: Params) -> str:
    """Sizes alone allow the similarity."""
    return f"100 * least({a}, {b}) >= {p.percent} * greatest({a}, {b})"


def _dealt(rows: DataFrame, group: str, weight: str, most: int, scratch: Scratch) -> DataFrame:
    """rows (group, rep, component, ...) of groups with several components, with side, p and q.

    Members of different components shall meet in a common (group, p, q). A group
    whose weights sum to ``most`` or less meets whole. A larger one is cut into
    sides of about that weight: the largest component into inner sides, which
    never meet each other, and the rest into outer sides, which meet every side.
    So a member of the largest component is repeated once for each outer side
    only, and one without other components in its group isn't repeated at all.
    """
    per = rows.groupBy(group, "component").agg(F.sum(F.expr(weight)).alias("w"))
    sums = per.groupBy(group).agg(
        F.max(F.struct("w", "component")).alias("top"), F.sum("w").alias("all"), F.count("*").alias("parts")
    )
    whole = F.col("all") <= most
    sums = scratch.keep(
        sums.where("parts > 1").select(
            group, F.col("top.component").alias("top"),
            F.when(whole, 1).otherwise(F.ceil((F.col("all") - F.col("top.w")) / most)).cast("long").alias("outer"),
            F.when(whole, 0).otherwise(F.ceil(F.col("top.w") / most)).cast("long").alias("inner"),
        )
    )
    inside = (F.col("component") == F.col("top")) & (F.col("inner") > 0)
    side = F.when(inside, F.col("outer") + F.pmod(F.xxhash64("rep"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("outer")))
    meets = F.when(inside, F.expr("sequence(0L, outer - 1)")).otherwise(F.expr("sequence(0L, outer + inner - 1)"))
    dealt = rows.join(sums, group).withColumn("side", side).withColumn("_with", F.explode(meets))
    return dealt.withColumn("p", F.least("side", "_with")).withColumn("q", F.greatest("side", "_with")).drop("top", "outer", "inner", "_with")


def _grouped(rows: DataFrame, group: str, columns: tuple[str, ...], work, schema: str) -> DataFrame:
    """work(columns of a group, crossing) for each (group, p, q); crossing: only members of different sides meet."""
    names = (group, "p", "q", "side", *columns)
    first, second = (x.split()[0] for x in schema.split(", "))

    def groups(batches):
        """Sorted rows, cut where the group changes; a group may span batches."""
        rest: list[dict] = []

        def joined(parts: list[dict]) -> dict:
            return {c: np.concatenate([part[c] for part in parts]) for c in names}

        for batch in batches:
            got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            change = np.zeros(len(got[group]) - 1, bool)
            for c in names[:3]:
                change |= got[c][1:] != got[c][:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(got[group])]
            for a, b in zip(edges[:-1], edges[1:]):
                part = {c: got[c][a:b] for c in names}
                if rest and any(rest[0][c][0] != part[c][0] for c in names[:3]):
                    yield joined(rest)
                    rest = []
                rest.append(part)
        if rest:
            yield joined(rest)

    def run(batches):
        for one in groups(x for x in batches if x.num_rows):
            a, b = work(one, one["p"][0] != one["q"][0])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[first, second])

    sorted_ = rows.select(*names).repartition(group, "p", "q").sortWithinPartitions(group, "p", "q")
    return sorted_.mapInArrow(run, schema)


def _meetings(root: np.ndarray, side: np.ndarray, n: np.ndarray, i: int, p: Params, crossing: bool) -> tuple[np.ndarray, int]:
    """Members after i, by size, that it may be linked with and isn't yet, and the first one beyond its sizes."""
    last = int(np.searchsorted(n, n[i] * 100 // p.percent, "right"))
    j = np.arange(i + 1, last)
    return j[(root[j] != root[i]) & ((side[j] != side[i]) if crossing else True)], last


def _clumps(p: Params):
    """Members of a bucket that an upper bound lets be linked, each with the least member of its clump."""

    def work(rows: dict, crossing: bool):
        order = np.lexsort((rows["rep"], rows["n"]))
        n, rep, side = (rows[c][order] for c in ("n", "rep", "side"))
        _, component = np.unique(rows["component"][order], return_inverse=True)
        sketch = [np.frombuffer(x, np.uint16) for x in rows["bins"][order]]
        width = np.fromiter(map(len, sketch), np.int64, len(sketch))
        clump, met = np.arange(len(n)), np.zeros(len(n), bool)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            at = np.flatnonzero((width >= w) & (n <= n[own[-1]] * 100 // p.percent))
            folded = np.stack([sketch[k].astype(np.int64).reshape(w, -1).sum(1) for k in at.tolist()]).astype(np.int32)
            where = np.full(len(n), -1)
            where[at] = np.arange(len(at))
            for i in own.tolist():
                j, _ = _meetings(component, side, n, i, p, crossing)
                if not len(j):
                    continue
                most = np.minimum(folded[where[j]], folded[where[i]]).sum(1, dtype=np.int64)
                j = j[100 * most >= p.percent * (n[j] + n[i] - most)]
                met[j] = True
                met[i] |= len(j) > 0
                if len(apart := np.unique(clump[j][clump[j] != clump[i]])):
                    clump[np.isin(clump, apart)] = clump[i]
        out = np.flatnonzero(met)
        lowest = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(lowest, clump[out], rep[out])
        return rep[out], lowest[clump[out]]

    return work


def _links(p: Params):
    """Links of a group by full shingle sets that join its components, one for each two that meet."""

    def work(rows: dict, crossing: bool):
        hashes = Hashes()
        sets = [shingles(t, p.words, hashes) for t in rows["text"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        order = np.lexsort((rows["rep"], sizes))
        n, rep, side = sizes[order], rows["rep"][order], rows["side"][order]
        _, root = np.unique(rows["component"][order], return_inverse=True)
        _, flat = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True)
        ends = np.cumsum(n)
        starts = ends - n
        mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
        out_a, out_b = [], []
        for i in range(len(n)):
            j, last = _meetings(root, side, n, i, p, crossing)
            if not len(j) or not n[i]:
                continue
            own = flat[starts[i] : ends[i]]
            mark[own] = True
            if 4 * len(j) > last - i:
                held = np.add.reduceat(mark[flat[starts[i + 1] : ends[last - 1]]], starts[i + 1 : last] - starts[i + 1], dtype=np.int64)[j - i - 1]
            else:
                held = np.fromiter((np.count_nonzero(mark[flat[starts[k] : ends[k]]]) for k in j.tolist()), np.int64, len(j))
            mark[own] = False
            j = j[100 * held >= p.percent * (n[i] + n[j] - held)]
            for k in j.tolist():
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    out_a.append(min(rep[i], rep[k]))
                    out_b.append(max(rep[i], rep[k]))
        return out_a, out_b

    return work


def texts_of(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text of the rows of docs that ids (_id) names, written.

    Only these are shuffled: a Bloom filter of their ids is pushed below the
    exchange. It needs a written table with a predicate to start from.
    """
    ids = scratch.keep(ids).where(F.col("_id") >= -(1 << 63))
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    with settings(docs.sparkSession, BLOOM):
        return scratch.keep(texts)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    scratch = Scratch(docs.sparkSession, "neardup")
    small_batches(docs.sparkSession)
    sig = scratch.keep(signatures(docs, p))
    real = sig.where("n > 0 and doc_id is not null")
    reps = scratch.keep(
        real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("c").alias("c"), F.min("bins").alias("bins"))
    )
    keys = reps.select("rep", "n", F.explode(F.expr(_keys(p.collections))).alias("key"))
    shared = keys.groupBy("key").agg(F.min_by(F.struct("rep", "n"), "rep").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = scratch.keep(keys.join(shared, "key").select("key", "rep", "n", "centre"))
    pairs = scratch.keep(
        members.where(f"rep <> centre.rep and {_close('n', 'centre.n', p)}")
        .select(F.col("centre.rep").alias("a"), F.col("rep").alias("b")).distinct()
    )
    links = confirmed(pairs, docs, p, scratch)
    first = scratch.keep(components(links, scratch)).select(F.col("id").alias("rep"), "component")
    placed = members.select("key", "rep").join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = _dealt(placed, "key", "1", p.block, scratch).join(reps.select("rep", "n", "bins"), "rep")
    clumped = _grouped(open_, "key", ("rep", "n", "bins", "component"), _clumps(p), "a long, b long")
    clumps = scratch.keep(components(clumped, scratch).select(F.col("id").alias("rep"), F.col("component").alias("clump")))
    texts = texts_of(docs, clumps.select(F.col("rep").alias("_id")), scratch)
    clumps = clumps.join(reps.select("rep", "n"), "rep").join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    verified = _dealt(clumps, "clump", "n + 200", 400 * p.block, scratch).join(texts, F.col("rep") == F.col("doc_id"))
    again = scratch.keep(_grouped(verified, "clump", ("rep", "component", "text"), _links(p), "a long, b long"))
    whole = components(links.unionByName(again), scratch)
    reach = reps.select("h1", "h2", "rep").join(whole, F.col("rep") == F.col("id"), "left")
    reach = reach.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", "h1", "h2").join(reach, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def deduplicate(docs: DataFrame, p: Params = Params(words=5, percent=80)) -> DataFrame:
    """docs without the rows whose component has a smaller id; repeated ids stay once."""
    found = near_duplicates(docs, p).where("doc_id is not null")
    kept = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("_tw_rows"))
    kept = kept.withColumnRenamed("doc_id", "_tw_id")
    some = docs.join(kept, F.col("doc_id") == F.col("_tw_id"))
    once = some.where("_tw_rows = 1").select(docs.columns)
    repeats = some.where("_tw_rows > 1").select(docs.columns).dropDuplicates(["doc_id"])
    return once.unionByName(repeats).unionByName(docs.where("doc_id is null"))
