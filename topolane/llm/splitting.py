"""Splitting oversized texts at natural boundaries, with overlap.

Separator hierarchy: section, paragraph, sentence or line, word, character. A piece is packed greedily up to the limit and
ends at the last boundary of the highest level that leaves it reasonably full; the next piece starts inside its tail,
at a boundary, at most `overlap_size` back. Sizes are the library's token estimate, which two prefix sums give for any
span, so a text takes time in proportion to its length and its pieces.

Cases: a text within the limit is one piece; null and empty texts give no piece; a record kind without a limit (or a null
kind) is not cut; mixed line ends and blank texts are text like any other; pieces cover the text without a gap, in order.
If the limit is too small for a single character, that character is a piece of its own with `over` true. Repeated
records are cut independently; extra columns are carried along.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topolane.functions.text import estimate_tokens

#: How full a piece must be for a boundary of each level to be taken; words and characters need no minimum.
LEAST_FILL = {"section": 0.5, "paragraph": 0.5, "sentence": 0.3, "word": 0.0}

PIECES = T.ArrayType(
    T.StructType([
        T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("overlap_tokens", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("boundary", T.StringType()),
        T.StructField("over", T.BooleanType()), T.StructField("text", T.StringType()),
    ])
)

_COMPILED: dict[str, object] = {}


def _patterns() -> dict:
    if not _COMPILED:
        import regex

        numbered = r"(?:[ \t]*\d+ \|)?"
        _COMPILED.update(
            run=regex.compile(r"[\p{Alphabetic}\p{N}_]+|[^\p{White_Space}\p{Alphabetic}\p{N}_]+"),
            # The end of each match is a boundary.
            section=regex.compile(rf"(?:\r\n|\n|\r)(?=\#{{1,6}} |{numbered} ?(?:@\w+|(?:pub |export |async |static |public |private |default |abstract |final )*(?:fn|def|class|struct|enum|impl|trait|interface|func|function|mod|type|package) ))"),
            paragraph=regex.compile(rf"(?:\r\n|\n|\r){numbered}[ \t]*(?:(?:\r\n|\n|\r)|\Z)(?:{numbered}[ \t]*(?:\r\n|\n|\r))*"),
            sentence=regex.compile(r"\r\n|\n|\r|[.!?…]+[\"'”’»)\]]*\p{White_Space}+|[。！？]+[」』”’]*"),
            word=regex.compile(r"\p{White_Space}+|[,;:|/]+(?=[^\p{White_Space}])|→"),
            char=regex.compile(r"\X"),
        )
    return _COMPILED


class Sizes:
    """Token estimate of any span of one text."""

    def __init__(self, text: str):
        n = len(text)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        self.bytes = np.concatenate([[0], np.cumsum(width)])
        starts = np.zeros(n + 1, dtype=np.int64)
        self.inside = np.zeros(n + 1, dtype=np.int64)  # 1 where a position lies inside a run, past its start
        for m in _patterns()["run"].finditer(text):
            a, b = m.span()
            starts[a + 1] += 1
            self.inside[a + 1 : b] = 1
        self.runs = np.cumsum(starts)

    def __call__(self, a: int, b: int) -> int:
        if a >= b:
            return 0
        runs = int(self.runs[b] - self.runs[a] + self.inside[a])
        n_bytes = int(self.bytes[b] - self.bytes[a])
        return (max(-(-n_bytes // 3), runs) * 105 + 99) // 100

    def reach(self, a: int, limit: int, n: int) -> int:
        """Largest end whose span from a is within the limit."""
        lo, hi = a, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self(a, mid) <= limit:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def back(self, b: int, limit: int, least: int) -> int:
        """Smallest start whose span to b is within the limit."""
        lo, hi = least, b
        while lo < hi:
            mid = (lo + hi) // 2
            if self(mid, b) <= limit:
                hi = mid
            else:
                lo = mid + 1
        return lo


def split_text(text: str, max_size: int, overlap_size: int) -> list[tuple]:
    """(piece_no, start, end, overlap_tokens, n_tokens, boundary, over, text) of each piece."""
    pats, n = _patterns(), len(text)
    size = Sizes(text)
    ends: dict[str, list[int]] = {}

    def boundaries(level: str) -> list[int]:
        if level not in ends:
            ends[level] = [m.end() for m in pats[level].finditer(text)]
        return ends[level]

    def last(level: str, low: int, high: int) -> int | None:
        """Last boundary in (low, high]."""
        at = boundaries(level)
        i = bisect.bisect_right(at, high)
        return at[i - 1] if i and at[i - 1] > low else None

    out: list[tuple] = []
    start, done = 0, 0  # done: everything before it is in some piece
    while done < n:
        high, cut_at, level = size.reach(start, max_size, n), None, "end"
        if high >= n:
            cut_at = n
        else:
            for level, fill in LEAST_FILL.items():
                low = max(done, size.reach(start, int(fill * max_size), n)) if fill else done
                if (cut_at := last(level, low, high)) is not None:
                    break
            if cut_at is None:
                level, cut_at = "character", last("char", done, high)
            if cut_at is None:  # not even one whole character sequence fits
                if start < done:
                    start = done
                    continue
                cut_at = high if high > done else done + 1
        tokens = size(start, cut_at)
        out.append((len(out), start, cut_at, size(start, done) if start < done else 0, tokens, level, tokens > max_size, text[start:cut_at]))
        done = cut_at
        if done >= n:
            break
        start = done
        if overlap_size > 0:
            low = size.back(done, overlap_size, out[-1][1] + 1)
            for lv in ("sentence", "word", "char"):
                at = boundaries(lv)
                i = bisect.bisect_left(at, low)
                if i < len(at) and at[i] < done and (lv != "sentence" or size(at[i], done) * 2 >= overlap_size):
                    start = at[i]
                    break
    return out


def split(df: DataFrame, limits: DataFrame, text: str = "text", kind: str = "record_kind", prefix: str = "evidence:") -> DataFrame:
    """`df` with max_size, overlap_size, n_tokens_whole and `pieces` (array of struct).

    `limits` is a small table by its nature (one row a kind); it is broadcast. Only texts above their limit go to Python.
    """
    lim = limits.where(F.col("applies_to").startswith(prefix)).select(
        F.expr(f"substring(applies_to, {len(prefix) + 1})").alias("__kind"), "max_size", "overlap_size"
    )
    lim = lim.groupBy("__kind").agg(F.min("max_size").alias("__max"), F.min("overlap_size").alias("__overlap"))
    base = df.withColumn("__size", estimate_tokens(F.col(text)))
    joined = base.join(F.broadcast(lim), F.col(kind) == F.col("__kind"), "left")

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series, most: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, int(m), int(o)) for t, m, o in zip(texts, most, overlap)], dtype=object)

    over = F.col("__size") > F.col("__max")
    joined = joined.withColumn("__cut", cut(F.when(over, F.col(text)), F.coalesce("__max", F.lit(1)), F.coalesce("__overlap", F.lit(0))))
    one = F.array(
        F.struct(
            F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.char_length(text).alias("end"), F.lit(0).alias("overlap_tokens"),
            F.col("__size").cast("int").alias("n_tokens"), F.lit("end").alias("boundary"), F.lit(False).alias("over"), F.col(text).alias("text"),
        )
    )
    none = F.array().cast(PIECES)
    pieces = F.when(over, F.col("__cut")).when(F.col("__size") > 0, one.cast(PIECES)).otherwise(none)
    keep = [F.col(c) for c in df.columns if c not in ("max_size", "overlap_size", "n_tokens_whole", "pieces")]
    return joined.select(*keep, F.col("__max").alias("max_size"), F.col("__overlap").alias("overlap_size"), F.col("__size").alias("n_tokens_whole"), pieces.alias("pieces"))


def was_cut(pieces: Column | str = "pieces") -> Column:
    """True where the splitter had to act."""
    p = F.col(pieces) if isinstance(pieces, str) else pieces
    return (F.size(p) > 1) | F.exists(p, lambda x: x["over"])
