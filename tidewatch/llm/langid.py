"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is read from a file; each language gets a
probability for every piece, learned here by expectation maximisation over the
words of labelled texts. A word's likelihood is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product
over its words. All of this runs on arrays for many words at once, and each
distinct word is computed once while it stays in a task's cache.

Learning takes at most ``per_language`` texts of each language, chosen by a hash
of their ids; prediction covers whole texts and whole words, however long. Words
are lower-cased runs of letters, with the marks on them.

Defined results: a null text or one without letters (digits, number forms and
signs are none) is ``und`` with score 0; rows without a language aren't learned
from, and without any learned language all rows are ``und``; ties go to the first
language by name; repeated rows give repeated results, and rows that repeat an id
are learned from together; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import crc_fold, small_batches, table

#: A letter (category L), and the letters and marks (M) that follow it.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
#: Likelihoods of longer words are computed as logarithms, as a product of so many probabilities could vanish.
PLAIN = 24
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Piece of any single character that the vocabulary lacks.
UNKNOWN = 0
P = np.uint64(0x100000001B3)


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model; a leading mark is a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(x for x in pieces if x.strip("▁") and LETTERS.fullmatch(x.strip("▁")) and "▁" not in x[1:])


@dataclass
class Lattice:
    """All vocabulary pieces inside words, as edges from a position to a later one."""

    pieces: list[str]
    sets: list[tuple[np.ndarray, np.ndarray]] = field(init=False)
    prefixes: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.longest = max((len(x) for x in self.pieces), default=1)
        by: dict[int, dict[int, int]] = {}
        pre: dict[int, set] = {}
        for i, x in enumerate(self.pieces, 1):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for k, c in enumerate(x, 1):
                    h = (h ^ np.uint64(ord(c))) * P
                    h ^= h >> np.uint64(31)
                    if k < len(x):
                        pre.setdefault(k, set()).add(int(h))
            by.setdefault(len(x), {})[int(h)] = i
        self.sets, self.prefixes = [], []
        for k in range(1, self.longest + 1):
            at = by.get(k, {})
            keys = np.array(sorted(at), np.uint64)
            self.sets.append((keys, np.array([at[int(h)] for h in keys], np.int32)))
            self.prefixes.append(np.array(sorted(pre.get(k, ())), np.uint64))

    def edges(self, words: list[str]):
        """(from, to, piece) by end position within the word, then by end; starts and ends of words."""
        joined = "".join(f"▁{w}" for w in words)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        first = ends - sizes
        stop = np.repeat(ends, sizes)
        live = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        src, dst, ids = [], [], []
        for k in range(1, self.longest + 1):
            h = (h ^ codes[live + k - 1]) * P
            h ^= h >> np.uint64(31)
            keys, pieces = self.sets[k - 1]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
            else:
                at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            if k == 1:  # a single character is always a piece
                ids.append(np.where(hit, pieces[at] if len(pieces) else 0, UNKNOWN).astype(np.int32))
                src.append(live)
                dst.append(live + 1)
            else:
                src.append(live[hit])
                dst.append(live[hit] + k)
                ids.append(pieces[at[hit]] if len(pieces) else np.zeros(0, np.int32))
            more = self.prefixes[k - 1]
            if not len(more):
                break
            at = np.minimum(np.searchsorted(more, h), len(more) - 1)
            go = (more[at] == h) & (live + k < stop[live])
            live, h = live[go], h[go]
        src, dst, ids = map(np.concatenate, (src, dst, ids))
        # Positions after a word's last character share the number of the next word's first, so shift by word.
        word = np.repeat(np.arange(len(words)), sizes)
        shift = word[src]
        local = dst - first[word[src]]
        order = np.lexsort((dst, local))
        return (src + shift)[order], (dst + shift)[order], ids[order], local[order], first + np.arange(len(words)), ends + np.arange(len(words))

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language, shape words x languages."""
        long = np.fromiter((len(w) > PLAIN for w in words), bool, len(words))
        out = np.empty((len(words), probs.shape[1]))
        for which, part in ((~long, self._forward), (long, self._forward_logs)):
            if which.any():
                out[which] = part([w for w, x in zip(words, which.tolist()) if x], probs)
        return out

    def _forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        src, dst, ids, local, first, last = self.edges(words)
        alpha = np.zeros((int(last[-1]) + 1, probs.shape[1]))
        alpha[first] = 1
        for a, b in _runs(local):
            add = alpha[src[a:b]] * probs[ids[a:b]]
            to, at = np.unique(dst[a:b], return_index=True)
            alpha[to] = np.add.reduceat(add, at)
        return np.log(alpha[last])

    def _forward_logs(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        src, dst, ids, local, first, last = self.edges(words)
        logs = np.log(probs)
        alpha = np.full((int(last[-1]) + 1, probs.shape[1]), -np.inf)
        alpha[first] = 0
        for a, b in _runs(local):
            to, at = np.unique(dst[a:b], return_index=True)
            alpha[to] = np.logaddexp.reduceat(alpha[src[a:b]] + logs[ids[a:b]], at)
        return alpha[last]

    def expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, over words with weights, for one language."""
        long = np.fromiter((len(w) > PLAIN for w in words), bool, len(words))
        out = np.zeros(len(probs))
        for which, part in ((~long, self._expected), (long, self._expected_logs)):
            if which.any():
                out += part([w for w, x in zip(words, which.tolist()) if x], np.asarray(weights, float)[which], probs)
        return out

    def _expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        src, dst, ids, local, first, last = self.edges(words)
        alpha = np.zeros(int(last[-1]) + 1)
        alpha[first] = 1
        for a, b in _runs(local):
            to, at = np.unique(dst[a:b], return_index=True)
            alpha[to] = np.add.reduceat(alpha[src[a:b]] * probs[ids[a:b]], at)
        beta = np.zeros_like(alpha)
        beta[last] = weights / alpha[last]
        for a, b in reversed(_runs(local)):
            np.add.at(beta, src[a:b], beta[dst[a:b]] * probs[ids[a:b]])
        return np.bincount(ids, weights=alpha[src] * probs[ids] * beta[dst], minlength=len(probs))

    def _expected_logs(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        src, dst, ids, local, first, last = self.edges(words)
        logs = np.log(probs)
        alpha = np.full(int(last[-1]) + 1, -np.inf)
        alpha[first] = 0
        for a, b in _runs(local):
            to, at = np.unique(dst[a:b], return_index=True)
            alpha[to] = np.logaddexp.reduceat(alpha[src[a:b]] + logs[ids[a:b]], at)
        beta = np.full(len(alpha), -np.inf)
        beta[last] = np.log(weights) - alpha[last]
        for a, b in reversed(_runs(local)):
            np.logaddexp.at(beta, src[a:b], beta[dst[a:b]] + logs[ids[a:b]])
        return np.bincount(ids, weights=np.exp(alpha[src] + logs[ids] + beta[dst]), minlength=len(probs))


def _runs(local: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(local)) + 1
    edges = [0, *cut.tolist(), len(local)]
    return list(zip(edges[:-1], edges[1:]))


CHUNK = 10_000
#: Words whose likelihoods a task keeps.
CACHE = 150_000
#: Ids ranked for the sample, as a multiple of those taken.
SPARE = 8


def fit(lattice: Lattice, counts: dict[str, int], rounds: int = 4, smooth: float = 0.1) -> np.ndarray:
    """Piece probabilities of one language from its word counts."""
    n = len(lattice.pieces) + 1
    probs = np.full(n, 1.0 / n)
    words = sorted(counts)
    for _ in range(rounds):
        total = np.full(n, smooth)
        for i in range(0, len(words), CHUNK):
            part = words[i : i + CHUNK]
            total += lattice.expected(part, np.array([counts[w] for w in part], float), probs)
        probs = total / total.sum()
    return probs


def units(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def train(docs: DataFrame, learn: Column, pieces: list[str], per_language: int) -> tuple[list[str], np.ndarray]:
    ids = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    # One number for each language, as the model has one column for each.
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    if not sizes:
        return [], np.zeros((len(pieces) + 1, 0))
    # The ids of lowest hash: eight times as many as wanted, whatever the size of the table.
    bound = {x.lang: -(2.0**63) + 2.0**64 * min(1.0, SPARE * per_language / x.n) for x in sizes}
    below = F.element_at(F.create_map(*[F.lit(v) for pair in bound.items() for v in pair]), F.col("lang"))
    near = docs.where(learn & F.col("lang").isNotNull() & (F.xxhash64("doc_id").cast("double") <= below))
    low = near.select("lang", "doc_id", F.xxhash64("doc_id").alias("_hash")).distinct()
    first = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    chosen = low.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= per_language)
    chosen = chosen.select(F.col("doc_id").alias("_id")).distinct()
    rows = near.join(chosen, F.col("doc_id") == F.col("_id"), "left_semi")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            got: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in units(text):
                    got[lang, w] = got.get((lang, w), 0) + 1
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in got]), pa.array([k[1] for k in got]), pa.array(list(got.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )

    words = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    by: dict[str, dict[str, int]] = {}
    for lang, word, n in words.groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        by.setdefault(lang, {})[word] = n
    langs = sorted(by)
    lattice = Lattice(pieces)
    probs = [fit(lattice, by[x]) for x in langs]
    return langs, np.stack(probs, 1) if probs else np.zeros((len(pieces) + 1, 0))


class WordScores:
    """Log-likelihoods of words in each language, kept for at most CACHE words besides those of the last texts."""

    def __init__(self, lattice: Lattice, probs: np.ndarray):
        self.lattice, self.probs = lattice, probs
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, self.probs.shape[1]))

    def totals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The sum over each text's words."""
        new = dict.fromkeys(w for words in texts for w in words if w not in self.at)
        if len(self.at) + len(new) > CACHE:
            self._clear()
            new = dict.fromkeys(w for words in texts for w in words)
        todo = list(new)
        parts = [self.lattice.forward(todo[i : i + CHUNK], self.probs) for i in range(0, len(todo), CHUNK)]
        self.at.update(zip(todo, range(len(self.at), len(self.at) + len(todo))))
        self.table = np.concatenate([self.table, *parts])
        return [self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0) for words in texts]


def groups(texts: list[str | None], words: int = 20 * CHUNK):
    """Lists of the word lists of consecutive texts, each of so many words or one text more."""
    part, n = [], 0
    for text in texts:
        part.append(units(text))
        n += len(part[-1])
        if n >= words:
            yield part
            part, n = [], 0
    if part:
        yield part


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], pieces: list[str]) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, *model))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        own, langs, probs = shared.value
        known = WordScores(Lattice(own), probs)
        for batch in batches:
            names, scores = [], []
            for texts in groups(batch.column(1).to_pylist()):
                for words, total in zip(texts, known.totals(texts) if langs else texts):
                    share = np.exp(total - total.max()) if words and langs else None
                    names.append("und" if share is None else langs[int(share.argmax())])
                    scores.append(0.0 if share is None else float(1 / share.sum()))
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 800, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns outside the held-out third."""
    pieces = read_pieces(vocabulary)
    model = train(docs, crc_fold("doc_id", 3) != 1, pieces, per_language)
    return predict(docs, model, pieces).select(
        "doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
