"""Near duplicates, mixing, URL lists, personal data, and the pipeline."""

import datetime
import hashlib
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import mixing, neardup, pii, registry, urls
from tidewatch.llm.common import Scratch
from tidewatch.llm.components import components

DATA = "/root/testdata/sf0.001"


# Near duplicates -----------------------------------------------------------------------------


def sets(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def components_brute(rows, p):
    made = {i: sets(t, p.words) for i, t in rows}
    root = {i: i for i in made}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(made)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = made[i], made[j]
            if a and b and 100 * len(a & b) >= p.percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(made[i]), find(i)) for i in ids}


def family(n=260):
    """Copies, chains in which only neighbours are linked, a shared passage, and unrelated texts."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(40)]
    rows, chain = [], list(base)
    for i in range(n):
        kind = i % 5
        if kind == 0:
            text = list(base)
            text[rng.integers(60)] = word()
        elif kind == 1:
            chain[(i * 7) % 60] = word()
            text = list(chain)
        elif kind == 2:
            text = passage + [word() for _ in range(20)]
        elif kind == 3:
            text = rows[rng.integers(len(rows))][1].split()
        else:
            text = [word() for _ in range(rng.integers(0, 30))]
        rows.append((1000 - i, " ".join(text)))
    return rows


@pytest.mark.parametrize("p", [neardup.Params(), neardup.Params(words=5, percent=80), neardup.Params(block=3)])
def test_components_against_brute_force(spark, p):
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, p).collect()}
    assert got == components_brute(rows, p)


def chains(spark, n, own=40, shared=120):
    """Two chains of n texts: all share a passage, and only neighbours of a chain are similar enough."""
    rows = []
    for c in (0, 1):
        for i in range(n):
            moving = [f"c{c}w{k}" for k in range(own * i // 8, own * i // 8 + own)]
            rows.append((2 * i + c, " ".join([f"p{k}" for k in range(shared)] + moving)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_a_hot_bucket_gives_links_and_not_pairs(spark):
    n, p = 500, neardup.Params(block=150)
    rows, df = chains(spark, n)
    assert components_brute(rows[:30], p)[28][1] == 0  # a chain hangs together by its neighbours
    scratch = Scratch(spark, "t")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, p).collect()}
    assert got == {i: i % 2 for i, _ in rows}
    # The last stage by itself: each text a component of its own, in one clump of several blocks.
    clump = df.select(F.col("doc_id").alias("rep"), F.lit(0).cast("long").alias("clump"), F.col("doc_id").alias("component"), F.lit(160).alias("n"), "text")
    dealt = neardup._dealt(clump, "clump", "n + 200", 400 * p.block, scratch)
    assert dealt.count() < 2 * n * 2 * n / 100
    links = neardup._grouped(dealt, "clump", ("rep", "component", "text"), neardup._links(p), "a long, b long")
    blocks = dealt.select("p", "q").distinct().count()
    assert links.count() < blocks * 2 * n and blocks > 3
    found = {r.id: r.component for r in components(links, scratch).collect()}
    assert found == {i: i % 2 for i, _ in rows}


def test_bound_loses_no_link(spark):
    """Whatever the bound lets pass holds all links, between sketches of one width and of two."""
    rng = np.random.default_rng(2)
    p, hashes, rows = neardup.Params(), neardup.Hashes(), []
    for f, size in enumerate((40, 300, 511, 515, 1030, 2100)):
        base = [f"f{f}w{k}" for k in range(size)]
        for _ in range(8):
            text = list(base)
            for k in rng.integers(0, size, rng.integers(0, size // 60 + 2)):
                text[k] = f"x{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(text[: int(size * rng.uniform(0.93, 1))])))
    sig = {r.doc_id: r for r in neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    ids = np.array(sorted(sig))
    group = {"rep": ids, "side": ids * 0, "component": ids, "n": np.array([sig[i].n for i in ids]), "bins": np.array([bytes(sig[i].bins) for i in ids], object)}
    rep, clump = neardup._clumps(p)(group, False)
    of = dict(zip(rep.tolist(), clump.tolist()))
    made = {i: set(neardup.shingles(t, p.words, hashes).tolist()) for i, t in rows}
    linked = [(i, j) for i in made for j in made if i < j and 100 * len(made[i] & made[j]) >= p.percent * len(made[i] | made[j])]
    assert len(linked) > 30 and all(of.get(i, -1) == of.get(j, -2) for i, j in linked)


def test_an_id_with_two_texts_is_one_document(spark):
    a, b = ("one two three four five six seven " * 3).strip(), ("red green blue cyan pink grey gold " * 3).strip()
    df = spark.createDataFrame([(7, a), (7, b), (8, a), (9, b), (10, "else")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (10, 10, True)]
    assert sorted(r.doc_id for r in neardup.deduplicate(df).collect()) == [7, 10]


def test_number_of_collections():
    assert neardup.Params().collections == 12
    assert neardup.Params(words=5, percent=80).collections == 15


def test_neardup_edges(awkward, nothing):
    got = neardup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(by[i].kept for i in (1, 2, 3))
    assert by[7].component_id == 6 and not by[7].kept and by[5].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    left = neardup.deduplicate(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert neardup.near_duplicates(nothing).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df, Scratch(spark, "t")).collect()}
    root = {i: i for e in edges for i in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in edges)}


# Mixing --------------------------------------------------------------------------------------


def targets_brute(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mix(spark):
    rng = np.random.default_rng(3)
    names = ["b", None, "a", "zz", "é", "Z"]
    rows = [(i, " ".join("w" * int(rng.integers(0, 80))), names[min(int(rng.integers(0, 14)), 5)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=8).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
    want = targets_brute(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 80
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5), block=8).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_rounding_is_fair(spark):
    """Over seeds, a document is taken as often as its probability says."""
    df = spark.createDataFrame([(i, " ".join("w" * (i % 7 + 1)), "s" if i % 3 else "t") for i in range(40)], "doc_id long, text string, source string")
    copies = np.zeros(40)
    for seed in range(25):
        for r in mixing.mix(df, seed=seed, block=4).collect():
            copies[r.doc_id] += r.copies / 25
    share = {r.doc_id: r.target / r.source_size for r in mixing.mix(df).collect()}
    gap = np.array([copies[i] - share[i] for i in range(40)])
    assert abs(gap.mean()) < 0.1 and np.abs(gap).max() < 0.45


def test_mix_edges(awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.take(awkward)
    assert set(mixed.columns) == {*awkward.columns, "copies", "taken"} and mixed.where("copies < 1").count() == 0
    assert "MapInArrow" not in mixed._jdf.queryExecution().toString()
    kept = mixing.take(awkward.withColumn("copies", F.lit(99)).withColumn("taken", F.lit("x")))
    assert set(kept.columns) == {*awkward.columns, "copies", "taken", "copies_before", "taken_before"}
    assert {(r.copies_before, r.taken_before) for r in kept.collect()} == {(99, "x")}
    assert mixing.take(nothing).count() == 0


# URL lists -----------------------------------------------------------------------------------


def test_intervals_and_keys(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    events = [
        ("x", "Bad.com", "add", day(5)), ("x", "bad.com", "remove", day(10)), ("x", "bad.com", "add", day(20)), ("y", "good.org/ads", "add", day(1)),
        ("x", "bad.com", "add", day(5)), ("z", "tie.net", "add", day(3)), ("z", "tie.net", "remove", day(3)), (None, "n.com", "add", day(1)), ("x", None, "add", day(1)),
    ]
    captures = [
        (1, "http://bad.com/", day(4), False), (2, "https://WWW.bad.com:8080/p?q", day(5), True), (3, "http://bad.com", day(10), False),
        (4, "http://u@bad.com/", day(21), True), (5, "http://notbad.com/", day(6), False), (6, "http://good.org/ads", day(2), True),
        (7, "http://a.good.org/ads/1", day(2), True), (8, "http://good.org/adsense", day(2), False), (9, None, day(2), False), (10, "http://bad.com/", None, False),
        (11, "not a url", day(6), False), (12, "http://tie.net/", day(4), False), (4, "http://u@bad.com/", day(21), True), (None, "http://bad.com./", day(6), True),
    ]
    ev = spark.createDataFrame(events, "list string, entry string, action string, at timestamp_ntz")
    cap = spark.createDataFrame([(*c, "clash") for c in captures], "page_id long, url string, fetched_at timestamp_ntz, want boolean, key string")
    got = urls.match(cap, ev)
    assert sorted((r.page_id or 0, r.blocked) for r in got.collect()) == sorted((c[0] or 0, c[3]) for c in captures)
    assert urls.match(cap.limit(0), ev).count() == 0 and urls.match(cap, ev.limit(0)).where("blocked").count() == 0


# Personal data -------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def pii_brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base(spark):
    rng = np.random.default_rng(8)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "_d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "+1 (974) 555-3436", "+12", "é", "😀", "\n", "9807915762804490", "12", "5", "word", "a", "%", ".5.6.7.8", "+"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(800)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = pii.find_pii(df).select("doc_id", F.expr(pii._text_of("base")).alias("s"), F.expr(pii._text_of("every")).alias("e")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.s == pii_brute(texts[r.doc_id]), repr(texts[r.doc_id])
        assert not r.s or set(r.s.split(",")) <= set(r.e.split(","))


def test_pii_bootstraps_unseen_identifiers(spark):
    rows = [(i, f"some words call me at +1 (974) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(20, "please call me at 974555-9999x now"), (21, "the build number 20240117-77 is out"), (22, "order 5551234-88 shipped")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.e for r in pii.find_pii(df).select("doc_id", F.expr(pii._text_of("every")).alias("e")).collect()}
    assert got[20] == "phone:18:30" and got[21] == "" and got[22] == ""
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[20] == "please call me at [PHONE] now" and masked[3] == "some words call me at [PHONE] thanks" and masked[22] == rows[-1][1]


def test_pii_confidence_counts_documents_without_digits(spark):
    rows = [(i, f"some words call me at +1 (974) 555-{1000 + i} thanks") for i in range(12)] + [(12, "call me at 974555-9999x now")]
    rows += [(20 + i, "they look me at home and stay") for i in range(60)]
    got = {r.doc_id: r.e for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.expr(pii._text_of("every")).alias("e")).collect()}
    assert got[12] == "" and got[3] == "phone:22:39"


def test_pii_finds_identifiers_of_any_shape(spark):
    rows = [(i, f"please write to ann{i}@mail.example today") for i in range(12)]
    rows += [(20 + i, f"we saw host address 10.0.0.{i} again") for i in range(12)]
    rows += [(40 + i, f"or call me at +1 (974) 555-{1000 + i} thanks") for i in range(24)]
    unseen = {
        60: ("please write to ann@localhost, then", "email:16:29"), 61: ("please write to ann(at)mail.example", "email:16:35"),
        62: ("we saw host address fe80::1 again", "ip:20:27"), 63: ("we saw host address 1.2.3.x again", "ip:20:27"),
        64: ("or call me at 974 555 343, thanks", "phone:14:25"), 65: ("or call me at 5551234 1.2.3.4", "phone:14:21,ip:22:29"),
        66: ("or call me at (974) 555 343", "phone:15:27"), 67: ("or call me at 974 555 and 343x", "phone:14:21"),
        68: ("or call me at " + "7" * 80, "phone:14:94"), 69: ("no mark (here) (at all) a (b", ""),
    }
    rows += [(i, t) for i, (t, _) in unseen.items()]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.e for r in found.select("doc_id", F.expr(pii._text_of("every")).alias("e")).collect()}
    assert {i: got[i] for i in unseen} == {i: e for i, (_, e) in unseen.items()}


def scores_brute(rows, support=5, confidence=0.6, rounds=3):
    """Spans by the graph: mentions, patterns, trust and scores in plain Python; one-line texts of words with single spaces."""
    norm = lambda w: re.sub("[0-9]", "0", w.lower())
    runs, found = {}, []
    for i, text in rows:
        words = text.split(" ")
        for k, w in enumerate(words):
            for r in [norm(w)] + ([norm(w) + " " + norm(words[k + 1])] if k + 1 < len(words) else []):
                runs[r] = runs.get(r, 0) + 1
            if re.search("[0-9@]", w):
                at = sum(len(x) + 1 for x in words[:k])
                base = pii_brute(w)
                kind = pii.KINDS.index(base.split(":")[0]) if base and base.split(":")[1:] == ["0", str(len(w))] else -1
                left, right = words[max(0, k - 2) : k], words[k + 1 : k + 3]
                own = [f"1<{norm(w)}" for w in left[-1:]] + [f"2<{norm(' '.join(left))}"] * (len(left) == 2)
                own += [f"1>{norm(w)}" for w in right[:1]] + [f"2>{norm(' '.join(right))}"] * (len(right) == 2)
                found.append((i, at, at + len(w), w.lower(), kind, own + ["=" + re.sub("[0-9]", "0", re.sub(r"[^\W\d_]+", "a", w))]))
    seed = {v: k for *_, v, k, _ in found if k >= 0}
    n_value = {v: sum(x[3] == v for x in found) for *_, v, _, _ in found}
    edges = {}
    for *_, v, _, ps in found:
        for x in ps:
            edges.setdefault(x, {})[v] = edges.get(x, {}).get(v, 0) + 1
    total = {x: max(sum(e.values()), 0 if x[0] == "=" else runs[x[2:]]) for x, e in edges.items()}

    def trusted(score):
        out = {}
        for x, e in edges.items():
            ok = [v for v in e if score.get(v, (0, 0))[0] >= confidence]
            share, n, z = min(1, sum(n * score.get(v, (0, 0))[0] for v, n in e.items()) / total[x]), total[x], pii.Z
            low = (share + z * z / (2 * n) - z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if len(e) >= support and any(v not in seed for v in e) and len(ok) >= support and low >= confidence:
                kinds = [sum(score[v][1] == k for v in ok) for k in range(4)]
                out[x] = (low, kinds.index(max(kinds)))
        return out

    score = {v: (1.0, k) for v, k in seed.items()}
    by = trusted(score)
    for _ in range(rounds):
        for v in n_value:
            mine = [(by[x][0], -by[x][1], e[v]) for x, e in edges.items() if v in e and x in by and v not in seed]
            if mine:
                score[v] = (1 - np.prod([1 - min(t * n / n_value[v], 0.999999) for t, _, n in mine]), -max(mine)[1])
        by = trusted(score)
    out = {i: [] for i, _ in rows}
    for i, a, b, v, k, ps in found:
        best = [(by[x][0], -by[x][1]) for x in ps if x in by] + ([(score[v][0], -score[v][1])] if score.get(v, (0, 0))[0] >= confidence else [])
        if k >= 0 or best:
            out[i].append((a, k if k >= 0 else -max(best)[1], b))
    return {i: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x)) for i, x in out.items()}


def planted(n=400, seed=5):
    """Prose with identifiers after and before cue words, a fifth of them in forms no base expression takes, and numbers that are none."""
    rng = np.random.default_rng(seed)
    plain = ["river", "stone", "walked", "under", "bright", "morning", "letter", "garden", "at", "the", "number", "2", "of"]
    word = lambda: str(rng.choice(plain))
    rows, truth = [], {}
    for i in range(n):
        before, after = [word() for _ in range(rng.integers(2, 9))], [word() for _ in range(rng.integers(2, 9))]
        host, kind = f"10.{rng.integers(255)}.{rng.integers(255)}.{rng.integers(255)}", i % 4
        known = bool(rng.random() > 0.2)
        if kind == 0:
            middle, mark = ["mailbox", f"u{i}@mail.example" if known else f"u{i}@localhost"], 1
        elif kind == 1:
            middle, mark = [host if known else f"fe80::{i}a", "hostname"], 0
        elif kind == 2:
            middle, mark = ["ring", "us", f"+1(974)555{1000 + i}" if known else f"555-{1000 + i}", "soon"], 2
        else:
            middle, mark = ["order", f"{rng.integers(1000, 99999)}", "shipped"], None
        words = before + middle + after
        rows.append((i, " ".join(words)))
        if mark is not None:
            at = sum(len(x) + 1 for x in before + middle[:mark])
            truth[i] = (at, at + len(middle[mark]), known)
    return rows, truth


def test_pii_graph_against_brute_force_and_planted_identifiers(spark):
    rows, truth = planted()
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r.doc_id: r.e for r in found.select("doc_id", F.expr(pii._text_of("every")).alias("e")).collect()}
    assert got == scores_brute(rows)
    spans = {(i, *map(int, x.split(":")[1:])) for i, e in got.items() for x in e.split(",") if x}
    unseen = {(i, a, b) for i, (a, b, known) in truth.items() if not known}
    every = {(i, a, b) for i, (a, b, _) in truth.items()}
    assert len(unseen) > 50 and len(unseen & spans) / len(unseen) >= 0.95  # recall of what no base expression takes
    assert len(every & spans) / len(spans) >= 0.98  # precision


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_pii_discovers_on_the_test_tables(spark):
    """Phones that a following number spoils for the base expression are found by their form; numbers that fail Luhn aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]'")
    more = pii.find_pii(docs).select("doc_id", F.expr("array_except(every, base)").alias("new")).where("size(new) > 0")
    texts = {r.doc_id: r.text for r in docs.join(more.select("doc_id"), "doc_id").collect()}
    new = [(pii.KINDS[x.kind], texts[r.doc_id][x.start : x.end]) for r in more.collect() for x in r.new]
    assert new and all(k == "phone" and re.fullmatch(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", t) for k, t in new)


def test_pii_edges(awkward, nothing):
    got = pii.find_pii(awkward).collect()
    assert len(got) == awkward.count() and all(not r.every for r in got if r.doc_id in (1, 2, 3))
    masked = pii.mask(awkward)
    assert masked.columns == awkward.columns and masked.count() == awkward.count()
    assert masked.where("doc_id = 1").first().text is None
    assert pii.find_pii(nothing).count() == 0 and pii.mask(nothing).count() == 0


# The registered queries and the pipeline -----------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pipeline(spark):
    import corpus_pipeline
    from tidewatch.llm import decontaminate, neardup as nd

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    now, scratch = docs, Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = scratch.keep(stage(spark, now, DATA))
        after = {r.doc_id: r for r in now.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert now.columns == docs.columns
        if name == "near_duplicates":
            want = components_brute([(i, r.text) for i, r in before.items()], nd.Params(words=5, percent=80))
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        if name == "benchmark_decontamination":
            index = decontaminate.Index(bench, 8)
            hashes = decontaminate.Hashes()
            long = lambda t: any(b - a >= 8 for a, b in index.hits(decontaminate.words_of(t), hashes)[0])
            assert set(after) == {i for i, r in before.items() if not long(r.text)}
        if name == "pii":
            assert set(after) == set(before)
            assert all(pii_brute(r.text) == "" for r in after.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == set(after)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination", "pii", "mixing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_registered(spark, name):
    import duckdb

    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    table = "pages" if name == "op5_urls" else "documents"
    assert len(got) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in registry.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        rel = con.sql(registry.ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        assert got == sorted(tuple(str(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    if name == "op10_pii":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
        for r in df.collect():
            assert r.base_sha256 == hashlib.sha256(pii_brute(texts[r.doc_id]).encode()).hexdigest()
