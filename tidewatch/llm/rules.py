"""Quality rules: document statistics and a learned decision list over them.

Statistics come from one pass over every whole text. A decision list is learned
by sequential covering: each rule is a conjunction of thresholds that is grown
on two thirds of the labelled rows by information gain, pruned on the last
third, and removes what it covers; learning stops when no rule pays on the
pruning rows. The list becomes one ordered Spark ``CASE WHEN`` over the
statistics, so it can be read and runs without Python.

Only the fit uses labels, on at most ``max_labelled`` rows chosen by a hash of
their ids.

Defined results: a null or empty text has no words and fails the base rules;
unlabelled rows and null labels aren't learned from; without labelled rows of
both classes the list is empty and keeps what the base rules keep; repeated
labels of a document count once, by their smallest value, and rows that repeat
an id are learned from once, by the least of their statistics; repeated rows give
repeated results; very long texts are taken whole; ties between thresholds go to
the first statistic as listed; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, table

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_digits long, n_stops long"
#: Ratios that the list may test.
RATIOS = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    k = len(known)
    pair = ids[:-1] * k + ids[1:]
    if k < 2_000_000:
        triple = pair[:-1] * k + ids[2:]
    else:
        _, low = np.unique(pair, return_inverse=True)
        triple = low[:-1] * k + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    at = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    hit = np.zeros(n, bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    codes = np.frombuffer(raw, np.uint8)
    counts = np.bincount(codes, minlength=256)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    return (
        len(words),
        len(text) - int(sum(counts[ord(c)] for c in WHITE)),
        int(sum(counts[ord(c)] for c in SYMBOLS)),
        dups,
        repeated_words(words),
        lines,
        upper,
        upper + lower,
        int(counts[48:58].sum()),
        int(counts[ord(".")] + counts[ord("!")] + counts[ord("?")]),
    )


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        return lambda doc_id, text: (doc_id, *statistics(text))

    return map_rows(df.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text"), make, f"doc_id long, {STATS}")


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.value if self.above else x[self.name] <= self.value

    def sql(self) -> str:
        return f"({RATIOS[self.name]}) {'>=' if self.above else '<='} {self.value!r}D"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the threshold of the largest information gain until only bad rows are covered."""
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        base = np.log2(p / n) if p else -np.inf
        best, found = 1e-9, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            cum = np.cumsum(b)
            for above in (False, True):
                pos = (cum[-1] - cum[edge]) if above else cum[edge]
                tot = (len(v) - edge - 1) if above else edge + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / tot) - base), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best = gain[k]
                    found = Test(name, above, round(float((v[edge[k]] + v[edge[k] + 1]) / 2), 6))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    """(p - n) / (p + n) over what the rule covers."""
    inside = _covers(rule, x, len(bad))
    return float((2 * bad[inside].sum() - inside.sum()) / inside.sum()) if inside.any() else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_tests: int = 4, least: int = 5) -> list[Rule]:
    """Ordered rules that reject; precision is asked of each on the pruning rows."""
    fold = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules:
        grow, prune = left & ~fold, left & fold
        if bad[grow].sum() < least:
            break
        pick = lambda m: {k: v[m] for k, v in x.items()}
        rule = _grow(pick(grow), bad[grow], most_tests)
        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        if not cuts:
            break
        rule = max(cuts, key=lambda r: (_worth(r, pick(prune), bad[prune]), -len(r)))
        if _worth(rule, pick(prune), bad[prune]) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false for the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = F.expr(" AND ".join(t.sql() for t in rule))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 6000) -> list[Rule]:
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label_col).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    one = F.min(F.struct(*[c.split()[0] for c in STATS.split(", ")])).alias("_one")
    pdf = (
        with_statistics(rows)
        .groupBy("doc_id").agg(one)
        .select("doc_id", "_one.*")
        .join(F.broadcast(chosen), "doc_id")
        .selectExpr("doc_id", "_label", *[f"cast({e} as double) as {k}" for k, e in RATIOS.items()])
        .toPandas()
        .sort_values(["doc_id", *RATIOS], kind="stable")
    )
    # The pruning rows are every third by id hash order, not by id.
    pdf = pdf.sample(frac=1, random_state=5) if len(pdf) else pdf
    return learn({k: pdf[k].to_numpy(float) for k in RATIOS}, (pdf._label == 0).to_numpy())


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed and kept to a frame of statistics."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(with_statistics(docs), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
