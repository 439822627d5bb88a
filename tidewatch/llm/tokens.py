"""Token counts by offset-mapped attribution.

A whole document is encoded once by a public byte-level tokenizer. Tokens of
such a vocabulary concatenate to the text, so the cumulative sum of their byte
lengths gives their byte spans, and the first and last character that these bytes
belong to gives their spans of code points. Sections are spans of code points:
lines, paragraphs, or those of a column. They are joined to token spans by
interval: a token that crosses a boundary belongs to the section that holds most
of its characters, and to the earlier one if that is a tie. So the sums over
sections that leave no gap equal the document's tokens.

Sections of the registered query are the lines of a text, each with the line
feed that ends it; a paragraph ends with the last of the line feeds of an empty line.

Defined results: null and empty texts have no tokens and no sections of their own;
very long texts are encoded whole; a token outside every section counts as
unattributed; a character whose bytes several tokens share belongs to each of
them; null or empty spans of a column hold nothing; repeated rows give repeated
results; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import map_rows, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of this vocabulary; a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    def __init__(self, ranks: bytes, split: str = SPLIT):
        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=table_, special_tokens={})
        self.sizes = np.zeros(max(table_.values()) + 1, np.int64)
        for token, rank in table_.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte positions at which the tokens of a text end."""
        return np.cumsum(self.sizes[np.asarray(self.encoding.encode_ordinary(text), np.int64)])


def char_spans(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which the tokens of a text, given by their last bytes, begin and end."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    if text.isascii():
        return starts, ends
    at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
    return at[starts], at[ends - 1] + 1


#: What ends a section.
BREAKS = {"lines": re.compile("\n"), "paragraphs": re.compile(r"\n[ \t\r]*\n\s*")}


def edges(text: str, of: str = "lines") -> tuple[np.ndarray, np.ndarray]:
    """Code points at which the lines or paragraphs of a text begin and end."""
    ends = [m.end() for m in BREAKS[of].finditer(text)]
    ends = np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)], np.int64)
    return np.concatenate(([0], ends[:-1])), ends


def attribute(a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Tokens (spans a, b) of each section, tokens that cross an edge, tokens in no section.

    starts and ends are sorted, disjoint spans; gaps between them are allowed.
    """
    counts = np.zeros(len(starts), np.int64)
    where = np.flatnonzero(ends > starts)
    if not len(a) or not len(where):
        return counts, 0, len(a)
    s, e = starts[where], ends[where]
    first = np.searchsorted(e, a, "right")
    last = np.searchsorted(s, b, "left") - 1
    none = first > last
    one = first == last
    at = np.minimum(first, len(s) - 1)
    whole = one & (s[at] <= a) & (b <= e[at])
    np.add.at(counts, where[first[one]], 1)
    for i in np.flatnonzero(~none & ~one):
        k = np.arange(first[i], last[i] + 1)
        held = np.minimum(e[k], b[i]) - np.maximum(s[k], a[i])
        counts[where[k[int(held.argmax())]]] += 1
    return counts, int((~whole & ~none).sum()), int(none.sum())


SCHEMA = (
    "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, "
    "n_outside long, largest_section long, section_tokens string"
)


def count_tokens(
    docs: DataFrame, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text", sections: str = "lines"
) -> DataFrame:
    """Per row: tokens of the whole text, and of each of its sections, comma-joined in order.

    sections: lines, paragraphs, or a column of array<struct<start, end>>, sorted and disjoint.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    given = sections not in BREAKS

    def make():
        encoder = Encoder(shared.value)

        def row(doc_id, text, spans=None):
            text = text or ""
            if given:
                some = [(x["start"], x["end"]) for x in spans or [] if x and x["start"] is not None and x["end"] is not None]
                starts, ends = np.array(some, np.int64).reshape(-1, 2).T
            elif text:
                starts, ends = edges(text, sections)
            else:
                starts = ends = np.zeros(0, np.int64)
            a, b = char_spans(text, encoder.ends(text))
            counts, crossing, outside = attribute(a, b, starts, ends)
            return (
                doc_id, len(text), len(a), len(counts), crossing, outside, int(counts.max(initial=0)),
                ",".join(map(str, counts.tolist())),
            )

        return row

    columns = [f"`{id_col}` as doc_id", f"`{text_col}` as text", *([f"`{sections}` as spans"] if given else [])]
    return map_rows(docs.selectExpr(*columns), make, SCHEMA)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
