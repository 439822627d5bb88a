"""Whole queries against brute force on a small table, and each stage of the pipeline on awkward tables."""

import math
import os
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F
from test_tables import targets_brute
from test_texts import stats_brute

from tidewatch.llm import decontaminate, langid, mixing, neardup, pii, quality, registry, rules, urls
from tidewatch.llm.common import crc_fold

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@needs_data
def test_quality_query(spark, docs, marks):
    """Scores are the logistic of the mean of the weights of all words, n-grams and repeated bigrams."""
    p = quality.Params()
    weights, bias = quality.train(docs, marks, "quality", crc_fold("doc_id", 4) != 2, p)
    row = lambda s: float(weights[zlib.crc32(s) & (p.buckets - 1)])
    got = {r.doc_id: r for r in registry.QUERIES["op3_quality"](spark, DATA).collect()}
    for r in docs.collect():
        words = quality.doc_words(r.text)
        assert words == re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
        held = []
        for word in words:
            w = f"<{word.decode()}>"
            held += [row(word)] + [row(w[i : i + n].encode()) for n in range(p.least, p.most + 1) for i in range(len(w) - n + 1)]
        held += [float(weights[quality.same_row(p)])] * (quality.SAME * sum(a == b for a, b in zip(words, words[1:])))
        score = 1 / (1 + math.exp(-bias - (sum(held) / len(held) if held else 0)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-6)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@needs_data
def test_rules_query(spark, docs, marks):
    """The learned list, read off in order over statistics that are counted plainly."""
    learned = rules.fit_rules(docs, marks)
    got = {r.doc_id: r for r in registry.QUERIES["op6_rules"](spark, DATA).collect()}
    for r in docs.collect():
        n, chars, symbols, dups, repeats = stats_brute(r.text)
        text = r.text or ""
        lines = sum(bool(words_of(line)) for line in text.split("\n"))
        upper, letters = sum("A" <= c <= "Z" for c in text), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text)
        of = {
            "symbols_per_char": symbols / max(chars, 1), "dup_line_share": dups / max(lines, 1), "repeat_share": repeats / max(n, 1),
            "chars_per_word": chars / max(n, 1), "upper_share": upper / max(letters, 1), "digit_share": sum("0" <= c <= "9" for c in text) / max(chars, 1),
            "stops_per_word": sum(c in ".!?" for c in text) / max(n, 1), "words": float(n),
        }
        failed = n < 50 or 100 * repeats > 50 * n
        rejected = any(all(of[t.name] >= t.value if t.above else of[t.name] <= t.value for t in rule) for rule in learned)
        want = (n, chars, symbols, dups, repeats, failed, not failed and not rejected)
        assert tuple(got[r.doc_id])[1:] == want


@needs_data
def test_language_query(spark, docs):
    """The likelihood of a text, summed over all segmentations of each word one by one."""
    pieces = langid.read_pieces()
    langs, probs = langid.train(docs, crc_fold("doc_id", 3) != 1, pieces, 800)
    index, longest = {p: i for i, p in enumerate(pieces, 1)}, max(map(len, pieces))
    known = {}

    def chances(word):
        if word not in known:
            s = "▁" + word
            sums = [[1.0] * len(langs)] + [[0.0] * len(langs) for _ in s]
            for j in range(1, len(s) + 1):
                for i in range(max(0, j - longest), j):
                    if s[i:j] in index or j == i + 1:
                        p = probs[index.get(s[i:j], 0)]
                        sums[j] = [t + a * b for t, a, b in zip(sums[j], sums[i], p)]
            known[word] = [math.log(x) for x in sums[-1]]
        return known[word]

    got = {r.doc_id: r for r in registry.QUERIES["op8_langid"](spark, DATA).collect()}
    for r in docs.collect():
        words, word = [], ""
        for c in (r.text or "").lower() + " ":
            kind = unicodedata.category(c)[0]
            if kind == "L" or (kind == "M" and word):
                word += c
            elif word:
                words.append(word)
                word = ""
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        totals = [sum(x) for x in zip(*map(chances, words))]
        best = max(totals)
        assert got[r.doc_id].lang_pred == langs[totals.index(best)]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(t - best) for t in totals), abs=1e-6)


@needs_data
def test_mix_query(spark, docs):
    sizes, sources = {}, {}
    for r in docs.collect():
        sources[r.doc_id] = r.source
        sizes[r.source] = sizes.get(r.source, 0) + len(words_of(r.text))
    want, taken, most = targets_brute(sizes), dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.QUERIES["op4_mix"](spark, DATA).collect():
        s = sources[r.doc_id]
        assert r.size == len(words_of(texts[r.doc_id])) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[s], most[s] = taken[s] + r.taken, max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)  # a source misses by its last residual at most


def test_rows_that_repeat_an_id_are_learned_from_once(spark):
    rows = [(i, f"plain text {i} " * 30 if i % 2 else f"%%% #{i} " * 30) for i in range(60)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    hot = some.unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("z"), "id").alias("text")))
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    p = quality.Params(buckets=1 << 10, dim=4, epochs=2)
    a, b = (quality.train(df, marks, "quality", F.lit(True), p) for df in (some, hot))
    assert (a[0] == b[0]).all() and a[1] == b[1]
    seen = []
    learn, rules.learn = rules.learn, lambda x, bad: seen.append(len(bad)) or []
    try:
        rules.fit_rules(hot, marks)
    finally:
        rules.learn = learn
    assert seen == [60]


def test_urls_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.example.org/x", 5), (2, "", 1), (3, "http://[::1]/", 2)], "page_id long, url string, also long")
    got = urls.match(urls.dated_pages(pages), urls.derived_events(pages)).collect()
    assert len(got) == 4 and not any(r.blocked for r in got)  # a null id has no fetch time
    assert urls.match(urls.dated_pages(pages.limit(0)), urls.derived_events(pages.limit(0))).count() == 0


@pytest.fixture(scope="module")
def stages(labels, benchmark):
    small = quality.Params(max_labelled=400, buckets=1 << 12, dim=8, epochs=2)
    return {
        "quality": lambda df: quality.keep_quality(df, labels, params=small), "near duplicates": neardup.deduplicate,
        "benchmark": lambda df: decontaminate.remove(df, benchmark), "pii": pii.mask, "mixing": mixing.take,
    }


def test_stages_on_an_empty_table(nothing, stages):
    for stage in stages.values():
        assert stage(nothing).count() == 0


def test_stages_in_turn_on_an_awkward_table(awkward, stages):
    """All but the first keep the clean rows, nulls, empty and long texts among them; every column stays."""
    now = awkward.unionByName(awkward.where("doc_id = 4").withColumn("doc_id", F.lit(44).cast("long")))
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
    good = stages["quality"](now)
    assert good.columns == now.columns and set(ids(good)) <= set(ids(now))
    now = stages["near duplicates"](now)
    assert ids(now) == [-1, 1, 2, 3, 4, 5, 6, 8, 9, 10]  # 44 copies 4; both rows of 7 copy 6
    now = stages["benchmark"](now)
    assert ids(now) == [-1, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    before = {r.doc_id: r for r in now.collect()}
    now = stages["pii"](now)
    after = {r.doc_id: r for r in now.collect()}
    assert now.columns == awkward.columns and after[1].text is None and after[2].text == "" and after[4] == before[4]
    assert {tuple(r)[2:] for r in after.values()} == {tuple(r)[2:] for r in before.values()}
    mixed = stages["mixing"](now)
    assert set(ids(mixed)) <= set(after) - {None} | {-1} and mixed.columns[: len(now.columns)] == now.columns
