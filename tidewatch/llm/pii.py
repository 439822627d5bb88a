"""PII by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (email, ip, card, phone) come from regular expressions and checks.
They are the seeds. Every mention of a seed, and of any other identifier-shaped
token, has lexical patterns: one and two words before it, one and two words after
it, and its own form. Patterns and values form a bipartite graph, which Spark
scores in rounds. A pattern's trust is a lower bound of the share of its
occurrences that are with accepted values; words are counted in all documents, so
common words are no pattern, and forms in all mentions. A value's score is one
less the product of (1 - trust * share of its mentions) over its trusted patterns,
and a value of enough score counts as accepted in the next round. Tokens that a
trusted pattern or an accepted value vouches for are new spans, of the kind that
most of the pattern's accepted values have.

Positions are found natively: a text is split by the expression, and the lengths
of gaps and matches add up to code point positions. Expressions are written so
that no scan is quadratic in a long run: runs are taken whole (possessively) and
only from their start, which changes no match.

Defined results: a null text counts as empty and has no spans; very long texts
are taken whole; repeated rows give repeated results; a token inside a base span
is never a new span; a mention without a word beside it on its line has only the
pattern of its form; ties between patterns go to the kind listed first; an empty
table gives no rows. Other columns, whatever their names, are ignored by the
query and kept by ``mask``, of which a null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for an expression to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Identifier-shaped: groups of digits and signs that single spaces part, or else a token with a digit, @ or (at).
_GROUP = r"[(+]*+[0-9][0-9().+/-]*+"
_MARK = r"(?:[0-9@]|\((?i:at)\))"
TOKEN = (
    rf"(?<![^\x20\x09-\x0D])(?:{_GROUP}(?:\x20{_GROUP}(?=[,;:!?\x22\x27\]>}}]*+(?![^\x20\x09-\x0D])))++"
    rf"|[^\x20\x09-\x0D0-9@(]*+(?:\((?!(?i:at)\))[^\x20\x09-\x0D0-9@(]*+)*+{_MARK}[^\x20\x09-\x0D]*+)"
)
SPAN = "struct<start:bigint,kind:int,end:bigint,text:string>"


def _lit(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'


def _matches(kind: int, pattern: str, keep: str, text: str = "text") -> str:
    """Spans of all matches of a pattern in a text column that pass keep, an expression on x.text."""
    p = _lit(pattern)
    return f"""filter(aggregate(
      zip_with(slice(split({text}, {p}, -1), 1, greatest(size(regexp_extract_all({text}, {p}, 0)), 0)),
               regexp_extract_all({text}, {p}, 0), (g, m) -> named_struct('g', g, 'm', m)),
      named_struct('at', 0L, 'out', cast(array() as array<{SPAN}>)),
      (acc, x) -> named_struct(
        'at', acc.at + char_length(x.g) + char_length(x.m),
        'out', concat(acc.out, array(named_struct(
          'start', acc.at + char_length(x.g), 'kind', {kind},
          'end', acc.at + char_length(x.g) + char_length(x.m), 'text', x.m)))),
      acc -> acc.out), x -> {keep})"""


_DIGITS = r"regexp_replace(x.text, r'[^0-9]', '')"
_LUHN = f"""aggregate(transform(sequence(1, length({_DIGITS})), i -> cast(substring({_DIGITS}, -i, 1) as int) * if(i % 2 = 0, 2, 1)),
    0, (s, d) -> s + if(d > 9, d - 9, d)) % 10 = 0"""
KEEP = {
    "email": "true",
    "ip": r"forall(split(x.text, r'\.'), v -> length(regexp_replace(v, r'^0+(?=.)', '')) <= 3 and cast(right(v, 3) as int) <= 255)",
    "card": f"length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
_NONE = f"cast(array() as array<{SPAN}>)"


def base_spans() -> Column:
    """All base spans of column text, by start, kind, end."""
    parts = []
    for i, kind in enumerate(KINDS):
        need = f"contains(text, '{NEEDS[kind]}') and" if NEEDS[kind] else ""
        parts.append(f"if({need} text rlike '[0-9@]', {_matches(i, PATTERNS[kind], KEEP[kind])}, {_NONE})")
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


#: The text with a letter for each character of its base spans, so that no group of digits goes on into one.
_PLAIN = """if(size(base) = 0, text, aggregate(base, named_struct('at', 0L, 'out', ''),
    (acc, x) -> if(x.end <= acc.at, acc, named_struct('at', x.end, 'out', concat(acc.out,
        substring(text, cast(acc.at + 1 as int), cast(greatest(x.start - acc.at, 0) as int)),
        repeat('x', cast(x.end - greatest(x.start, acc.at) as int))))),
    acc -> concat(acc.out, substring(text, cast(acc.at + 1 as int)))))"""


def candidates() -> Column:
    """Identifier-shaped parts of text outside its base spans (plain: text without those), without outer punctuation."""
    raw = _matches(-1, TOKEN, "true", "plain")
    trimmed = r"""transform(raw, x -> named_struct(
        'start', x.start + char_length(regexp_extract(x.text, r'^([("\x27\[<{,;:=]*)', 1)),
        'kind', -1,
        'end', x.end - char_length(regexp_extract(x.text, r'([)"\x27\]>},;:.!?%&*$#]*)$', 1)),
        'text', regexp_replace(x.text, r'^[("\x27\[<{,;:=]+|[)"\x27\]>},;:.!?%&*$#]+$', '')))"""
    shape = f"x.text rlike r'{_MARK}'"
    apart = "not exists(base, b -> b.start < x.end and x.start < b.end)"
    made = f"filter({trimmed}, x -> {shape} and {apart})".replace("transform(raw,", f"transform({raw},")
    return F.expr(f"if(plain rlike r'{_MARK}', {made}, {_NONE})")


_GAP = r"[\x20\x09-\x0D]+"
#: Words on the line before and after mention m, no farther than the mentions that lie two before and two after it:
#: so the windows of a text's mentions are, all together, linear in the text.
_BEFORE = rf"""filter(split(trim(trailing '("\'[<' from rtrim(
    substring_index(substring(text, cast(m.since + 1 as int), cast(m.start - m.since as int)), '\n', -1))), r'{_GAP}'), w -> w <> '')"""
_AFTER = rf"""filter(split(trim(leading ')"\']>}},;:.!?%&*$#' from
    substring_index(substring(text, cast(m.end + 1 as int), cast(m.until - m.end as int)), '\n', 1)), r'{_GAP}'), w -> w <> '')"""
_PLACED = """transform(every, (x, i) -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'text', x.text,
    'since', if(i < 2, 0L, get(every, i - 2).start),
    'until', if(i + 2 < size(every), greatest(get(every, i + 2).start, x.end), cast(char_length(text) as bigint))))"""


def _words(of: str) -> str:
    """Words in lower case, with digits as 0, joined by a space."""
    return f"translate(lower(array_join({of}, ' ')), '123456789', '000000000')"


#: The patterns of a mention: one and two words before and after it, and its own form (letters as a, digits as 0).
_PATTERNS = rf"""filter(array(
    if(size(x.b) > 0, concat('1<', {_words('slice(x.b, -1, 1)')}), null), if(size(x.b) > 1, concat('2<', {_words('slice(x.b, -2, 2)')}), null),
    if(size(x.a) > 0, concat('1>', {_words('slice(x.a, 1, 1)')}), null), if(size(x.a) > 1, concat('2>', {_words('slice(x.a, 1, 2)')}), null),
    concat('=', translate(regexp_replace(x.m.text, r'\p{{L}}++', 'a'), '123456789', '000000000'))), y -> y is not null)"""
_FOUND = f"""transform(transform({_PLACED}, m -> named_struct('m', m, 'b', {_BEFORE}, 'a', {_AFTER})), x -> named_struct(
    'start', x.m.start, 'kind', x.m.kind, 'end', x.m.end, 'value', lower(x.m.text), 'patterns', {_PATTERNS}))"""
#: Every word, and every run of two words, of a text.
_RUNS = rf"""transform(array(filter(split(translate(lower(text), '123456789', '000000000'), r'{_GAP}'), w -> w <> '')), w ->
    concat(w, if(size(w) < 2, cast(array() as array<string>),
        transform(sequence(1, greatest(size(w) - 1, 1)), i -> concat(get(w, i - 1), ' ', get(w, i))))))[0]"""
#: Longs of the bit table that sorts out runs which no pattern has.
TABLE = 1 << 16


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), base spans, and found: spans and candidates with their patterns."""
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = one.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("base", base_spans())
    one = one.withColumn("plain", F.expr(_PLAIN)).withColumn("every", F.array_sort(F.concat("base", candidates())))
    return one.select(
        "doc_id", "row", F.expr("transform(base, x -> struct(x.start, x.kind, x.end))").alias("base"),
        F.expr(f"if(size(every) > 0, {_FOUND}, null)").alias("found"),
    )


def occurrences(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """run, total: how often each of runs (run, distinct) stands in all documents.

    A table of 64 * TABLE bits, whatever the number of runs, drops most others where
    they are; what is left is counted before it meets the wanted ones.
    """
    bit = F.pmod(F.xxhash64("run"), F.lit(64 * TABLE).cast("long")).alias("bit")
    spark = docs.sparkSession
    words = runs.select(bit).groupBy(F.expr("bit div 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    whole = spark.range(TABLE).join(words, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("t"))
    bits = whole.select(F.expr("transform(t, x -> x.bits)")).scalar()
    every = docs.where("text is not null").select(F.explode(F.expr(_RUNS)).alias("run")).withColumn("bit", bit).withColumn("bits", bits)
    some = every.where("getbit(element_at(bits, cast(bit div 64 as int) + 1), cast(bit % 64 as int)) = 1")
    return some.groupBy("run").agg(F.count("*").alias("total")).join(runs, "run")


#: One-sided 95 %: how far the share of a few occurrences may lie above the pattern's own.
Z = 1.645


def _at_least(good: Column, of: Column) -> Column:
    """Wilson's lower bound of a share: few occurrences prove little."""
    share = F.least(good / of, F.lit(1.0))
    spread = Z * F.sqrt(share * (1 - share) / of + Z * Z / (4 * of * of))
    return (share + Z * Z / (2 * of) - spread) / (1 + Z * Z / of)


def _graph(docs: DataFrame, each: DataFrame, scratch: Scratch, support: int) -> DataFrame:
    """pattern, total, value, n (mentions of both), n_value (all of the value), seed (its kind, or -1)."""
    values = scratch.keep(each.groupBy("m.value").agg(F.count("*").alias("n_value"), F.max("m.kind").alias("seed")))
    edges = each.select("m.value", F.explode("m.patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count("*").alias("n"))
    edges = scratch.keep(edges.join(values, "value"))
    # A pattern only matters if it has candidates and enough different values.
    useful = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.count_if(F.col("seed") < 0).alias("open"), F.sum("n").alias("met"))
    useful = scratch.keep(useful.where((F.col("values") >= support) & (F.col("open") > 0)).select("pattern", "met", F.expr("if(pattern like '=%', null, substring(pattern, 3))").alias("run")))
    runs = scratch.keep(useful.where("run is not null").select("run").distinct())
    totals = scratch.keep(occurrences(docs, runs)).withColumnRenamed("run", "_run")
    useful = useful.join(totals, F.col("run") == F.col("_run"), "left")
    useful = useful.select("pattern", F.greatest("met", "total").cast("double").alias("total"))
    return scratch.keep(edges.join(useful, "pattern"))


def _trusted(graph: DataFrame, support: int, confidence: float) -> DataFrame:
    """pattern, trust, as_kind of the confident patterns; graph has score and kind of each value."""
    sure = F.col("score") >= confidence
    kinds = [F.count_if(sure & (F.col("kind") == i)).alias(f"k{i}") for i in range(len(KINDS))]
    per = graph.groupBy("pattern", "total").agg(F.sum(F.col("score") * F.col("n")).alias("good"), F.count_if(sure).alias("sure"), *kinds)
    most = F.greatest(*[F.col(f"k{i}") for i in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"k{i}") == most, F.lit(i)) for i in range(len(KINDS))])
    per = per.select("pattern", _at_least(F.col("good"), F.col("total")).alias("trust"), kind.alias("as_kind"), "sure")
    return per.where((F.col("sure") >= support) & (F.col("trust") >= confidence)).drop("sure")


def discover(
    docs: DataFrame, found: DataFrame, scratch: Scratch, rounds: int = 3, support: int = 5, confidence: float = 0.6
) -> DataFrame:
    """row, doc_id, span of the candidates that confident patterns or accepted values vouch for.

    support: different accepted values that a pattern needs; confidence: the least
    lower bound of the share of a pattern's occurrences that are with accepted values,
    and the least score of an accepted value.
    """
    each = found.where(F.col("found").isNotNull()).select("row", "doc_id", F.explode("found").alias("m"))
    graph = _graph(docs, each, scratch, support)
    known = graph.withColumn("score", F.when(F.col("seed") >= 0, 1.0).otherwise(0.0)).withColumn("kind", F.col("seed"))
    trusted = scratch.keep(_trusted(known, support, confidence))
    for _ in range(rounds):
        # 1 - product of (1 - trust * share of the value's mentions), with full trust kept finite.
        vouched = graph.where("seed < 0").join(trusted, "pattern")
        doubt = F.log1p(-F.least(F.col("trust") * F.col("n") / F.col("n_value"), F.lit(0.999999)))
        scored = scratch.keep(
            vouched.groupBy("value").agg((1 - F.exp(F.sum(doubt))).alias("lift"), F.max(F.struct("trust", -F.col("as_kind"))).alias("by"))
            .select("value", "lift", (-F.col("by")["col2"]).alias("by_kind"))
        )
        both = graph.join(scored, "value", "left").withColumn("score", F.when(F.col("seed") >= 0, 1.0).otherwise(F.coalesce("lift", F.lit(0.0))))
        trusted = scratch.keep(_trusted(both.withColumn("kind", F.when(F.col("seed") >= 0, F.col("seed")).otherwise(F.col("by_kind"))), support, confidence))
    open_ = each.where("m.kind < 0").select("row", "doc_id", "m.start", "m.end", "m.value", "m.patterns")
    named = each.where("m.kind >= 0").groupBy("m.value").agg(F.lit(1.0).alias("sure"), F.min("m.kind").alias("as_kind"))
    sure = named.unionByName(scored.where(F.col("lift") >= confidence).select("value", F.col("lift").alias("sure"), F.col("by_kind").alias("as_kind")))
    where = ["row", "doc_id", "start", "end", "sure", "as_kind"]
    by_place = open_.withColumn("pattern", F.explode("patterns")).join(trusted.withColumnRenamed("trust", "sure"), "pattern").select(where)
    best = F.max(F.struct("sure", -F.col("as_kind")))["col2"]
    spans = open_.join(sure, "value").select(where).unionByName(by_place).groupBy("row", "doc_id", "start", "end").agg((-best).alias("kind"))
    return spans.select("row", "doc_id", F.struct("start", "kind", "end").alias("span"))


def _new_spans(docs: DataFrame, found: DataFrame, scratch: Scratch, *how) -> DataFrame:
    """_row, _doc, new (discovered spans), written, so that its size is known to the plan that joins it."""
    new = discover(docs, found, scratch, *how)
    return scratch.keep(new.groupBy(F.col("row").alias("_row"), F.col("doc_id").alias("_doc")).agg(F.collect_list("span").alias("new")))


_NO_SPANS = "cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"


def find_pii(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.6) -> DataFrame:
    """doc_id, row, base (spans), every (base and discovered spans, in order)."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(mentions(docs))
    new = _new_spans(docs, found, scratch, rounds, support, confidence)
    both = found.select("doc_id", "row", "base").join(
        new, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left"
    )
    return both.select("doc_id", "row", "base", F.array_sort(F.concat("base", F.coalesce("new", F.expr(_NO_SPANS)))).alias("every"))


def _text_of(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.expr(f"sha2({_text_of('base')}, 256)").alias("base_sha256"),
        F.expr(_text_of("every")).alias("spans"),
    )


def mask(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.6) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; all columns stay.

    Base spans are found again where the row is; only discovered spans are joined,
    and no text moves while Spark finds these small enough to broadcast.
    """
    scratch = Scratch(docs.sparkSession, "mask")
    new = _new_spans(docs, scratch.keep(mentions(docs)), scratch, rounds, support, confidence)
    new = new.select(F.col("_row").alias("_tw_row"), F.col("_doc").alias("_tw_doc"), F.col("new").alias("_tw_new"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    masked = f"""aggregate(_tw_spans, named_struct('at', 0L, 'out', ''),
        (acc, x) -> if(x.start < acc.at, named_struct('at', greatest(acc.at, x.end), 'out', acc.out), named_struct(
            'at', x.end,
            'out', concat(acc.out, substring(text, cast(acc.at + 1 as int), cast(x.start - acc.at as int)), {names}[x.kind]))),
        acc -> concat(acc.out, substring(text, cast(acc.at + 1 as int))))"""
    keyed = docs.withColumn("_tw_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    both = keyed.join(new, (F.col("_tw_key") == F.col("_tw_row")) & F.col("doc_id").eqNullSafe(F.col("_tw_doc")), "left")
    base = F.transform(base_spans(), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    both = both.withColumn("_tw_spans", F.array_sort(F.concat(base, F.coalesce("_tw_new", F.expr(_NO_SPANS)))))
    text = F.expr(f"if(size(_tw_spans) > 0, {masked}, text)").alias("text")
    return both.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])
