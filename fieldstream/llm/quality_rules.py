"""Quality rules: form of the text, and how public vocabularies take it.

Base rules look at words, lines and repeated 8-word windows.  The verdict on
what passes them comes from tokeniser fertility: two public vocabularies
measure characters per token, the share of byte-fallback tokens and the entropy of
tokens; a band for the text's main script says what is plausible.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts
from fieldstream.llm.vocab import END, SPACE, Memo, byte_bpe, pieces, uneven

# Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


@dataclass(frozen=True)
class Band:
    """What is plausible: characters per token in either vocabulary, and the largest share of byte-fallback tokens."""

    least_chars: float
    most_chars: float
    most_bytes: float


#: Plausible bands for each script.  Those of Latin come from the 3,302 rows of the sf0.1 documents that are labelled good
#: and pass the base rules: characters per token 1.95 at least, 2.96 at most, half of them over 2.6, where natural languages reach 6; byte-fallback
#: share 0.009 in the middle, 0.057 at most; entropy as measured below, 0.79 at least.  Every bound leaves room beyond these.  The tables have no
#: other script; there the bands follow from the vocabularies alone, which spell most of these letters in bytes or single characters, and are wide.
BANDS = {
    "latin": Band(1.75, 8.0, 0.12),
    "greek": Band(0.4, 4.0, 0.5),
    "cyrillic": Band(0.4, 5.0, 0.3),
    "hebrew": Band(0.3, 3.0, 0.7),
    "arabic": Band(0.3, 4.0, 0.7),
    "indic": Band(0.2, 3.0, 0.95),
    "thai": Band(0.2, 3.0, 0.95),
    "hangul": Band(0.2, 2.5, 0.98),
    "kana": Band(0.2, 2.5, 0.95),
    "han": Band(0.2, 2.5, 0.98),
    "other": Band(0.1, 9.0, 1.0),
}
#: First code point of each stretch, and its script; "" holds no letters.
STRETCHES = (
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x300, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
#: The least entropy of tokens, as a share of the logarithm of their number, counted up to ENTROPY_TOKENS.
LEAST_ENTROPY, ENTROPY_TOKENS = 0.75, 128

NAMES = list(BANDS)
STARTS = np.array([s for s, _ in STRETCHES], np.uint32)
OF = np.array([NAMES.index(n) if n else len(NAMES) for _, n in STRETCHES])


def main_script(text: str) -> str:
    """The script of most letters; without letters, "other"."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text[:200]) or any(c.isalpha() for c in text) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.max() < 0x370:  # Latin letters only, if any
        return "latin" if any(c.isalpha() for c in text) else "other"
    counts = np.bincount(OF[np.searchsorted(STARTS, points, "right") - 1], minlength=len(NAMES) + 1)[:-1]
    return NAMES[int(counts.argmax())] if counts.any() else "other"


def repeated_words(words: list) -> int:
    """Words that lie in an 8-word window which the text has twice or more.

    Ranks of windows of 1, 2, 4 and 8 words: a window's rank is that of the pair of its halves, so equal ranks mean equal words.
    """
    if len(words) <= WINDOW:
        return 0
    places = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    rank = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    distinct, half = len(places), 1
    while half < WINDOW:
        _, rank, counts = np.unique(rank[:-half] * distinct + rank[half:], return_inverse=True, return_counts=True)
        distinct = len(counts)
        if distinct == len(rank):  # no window is there twice, so no longer one is
            return 0
        half *= 2
    twice = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


class Fertility:
    """Both vocabularies at once; for a word with a space before it, the ids of one and the number of tokens of the other."""

    def __init__(self):
        self.pieces, self.bpe = pieces(), byte_bpe()
        self.memo = Memo(lambda words: zip(self.pieces.encode_many(words), [len(b) // 4 for b in self.bpe.encode_many(words)], strict=True))

    def measure(self, text: str) -> tuple[np.ndarray, int]:
        """Ids of the piece vocabulary, and the number of tokens of the byte-level one."""
        if not self.pieces.apart or uneven(text) or SPACE in text or END in text or not text:
            return self.pieces.ids(text), len(self.bpe.ids(text))
        first, *words = text.split(" ")
        found = self.memo.get(words)
        ids = np.frombuffer(b"".join([self.pieces.encode_many([first])[0], *[f[0] for f in found]]), "<u4")
        return ids, len(self.bpe.plain(first)) // 4 + sum([f[1] for f in found])


@lru_cache(maxsize=1)
def fertility() -> Fertility:
    """One for each worker process."""
    return Fertility()


def rejection(n_chars: int, ids: np.ndarray, n_byte_level: int, band: Band) -> tuple[str | None, float, float, float, float]:
    """Why the band rejects the text (None: it doesn't), and the four measures."""
    n = len(ids)
    if not n:
        return "empty", 0.0, 0.0, 0.0, 0.0
    per_piece, per_byte_level = n_chars / n, n_chars / max(n_byte_level, 1)
    share = float(pieces().byte[ids].mean())
    counts = np.bincount(ids)
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    why = None
    if not band.least_chars <= per_piece <= band.most_chars or not band.least_chars <= per_byte_level <= band.most_chars:
        why = "fertility"
    elif share > band.most_bytes:
        why = "bytes"
    elif entropy < LEAST_ENTROPY * math.log2(min(n, ENTROPY_TOKENS)):
        why = "entropy"
    return why, per_piece, per_byte_level, share, entropy


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reason string, script string, chars_per_piece double, chars_per_token double, byte_share double, entropy double"
SCHEMA = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (c.split() for c in COLUMNS.split(", "))])


def judge(text: str) -> tuple:
    """All columns but doc_id."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = repeated_words(words)
    base_failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    script = main_script(text)
    ids, n_byte_level = fertility().measure(text)
    why, *measures = rejection(len(text), ids, n_byte_level, BANDS[script])
    return (n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, base_failed, not base_failed and why is None, "base" if base_failed else why, script, *measures)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        rows = zip(*map(judge, batch.column(1).to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, SCHEMA.types[1:], strict=True))], schema=SCHEMA)


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, kept, the reason of a rejection, and the measures of fertility.

    A null text has no words, so it fails the base rules, as does an empty one.  A very long text is read whole.
    Rows are judged one by one: repeated rows get equal verdicts, a null doc_id stays null, an empty table gives no rows.  Other columns are not read, so their names don't matter.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_run, COLUMNS)


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        kept = batch.filter(pa.array([judge(t or "")[6] for t in texts], pa.bool_()))
        if kept.num_rows:
            yield kept


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, null and empty texts among them.

    All columns stay as they are, whatever their names; repeated rows stay or go together; an empty table stays empty; nothing is shuffled.
    """
    return docs.mapInArrow(_filter, docs.schema)
