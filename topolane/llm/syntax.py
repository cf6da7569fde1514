"""Source files that do not parse.

Files are lexed (in Arrow batches) and exploded into rows of tokens: each bracket, with the kinds up to the next one. Then

1. adjacent kinds are anti-joined against the pairs that the language's grammar permits;
2. nesting is reduced by windows over the rows of a file: a running sum gives the depth, and at every depth brackets must
   open and close by turns, each closing one the one before it (tags with the same name, indentation likewise);
3. every group, an innermost one or one whose groups are reduced to one letter each, must follow a production of its
   language: statements, members, fields, literals, parameters (`grammar`).

The depth of a file and the length of a statement are bounded by nothing: no step recurses over the input. Lexical errors
count as they are. The language is that of the path's extension; properties files are always valid, other extensions are
not judged. A row costs one exchange by file, and no row holds more than one file's text.

Cases: null and empty content, and files of comments only, are valid; both kinds of line ends are alike; a null path is
not judged; rescans are judged each, and so are repeated rows of one file_id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolane.llm.grammar import admissible, permitted
from topolane.llm.lexer import CLOSE, END, GROUPS, KEYWORDS, LANGUAGES, OPEN, START, lex
from topolane.session import cut

#: A bracket and the kinds up to the next one; the first row of a file has no bracket.
PIECE = r"[\^()\[\]{}<>][^()\[\]{}<>]*"
#: Contents judged are remembered in a worker, up to so many characters.
REMEMBER = 5_000_000


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = None
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, lang) if out is None else out.when(ext == e, lang)
    return out


def lexed(files: DataFrame) -> DataFrame:
    """(row, file_id, lang, kinds, error) of file_id, path, content; `row` tells repeated rows apart."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [lex(lang, text) for lang, text in zip(b["lang"], b["content"])]
            yield pd.DataFrame({"file_id": b["file_id"], "lang": b["lang"], "kinds": [k for k, _ in got], "error": [e for _, e in got]})

    judged = files.select("file_id", language(F.col("path")).alias("lang"), "content").where("lang is not null and lang <> 'properties' and content is not null and content <> ''")
    return judged.mapInPandas(go, "file_id long, lang string, kinds string, error string").withColumn("row", F.monotonically_increasing_id())


def token_rows(tokens: DataFrame) -> DataFrame:
    """(row, lang, pos, bracket, name, kinds, before): a row for each bracket of a file, `before` the kind in front of it."""
    rows = tokens.where("error is null").select("row", "lang", F.regexp_extract_all(F.concat(F.lit(START), "kinds"), F.lit(PIECE), F.lit(0)).alias("pieces"))
    # Of each piece only the last kind goes along with the next one.
    last = F.transform("pieces", lambda p: F.right(p, F.lit(1)))
    both = F.arrays_zip(F.col("pieces").alias("piece"), F.concat(F.array(F.lit(START)), F.slice(last, F.lit(1), F.size(last) - 1)).alias("before"))
    rows = rows.select("row", "lang", F.posexplode(both).alias("pos", "p")).select("row", "lang", "pos", "p.piece", "p.before")
    first = F.substring("piece", 1, 1)
    bracket = F.when(F.col("pos") > 0, first).otherwise("")
    tag = (F.col("lang") == "xml") & (F.col("pos") > 0)
    return rows.select(
        "row", "lang", "pos", bracket.alias("bracket"), F.when(tag, F.substring("piece", 2, 1)).otherwise("").alias("name"),
        F.expr("substring(piece, CASE WHEN lang = 'xml' AND pos > 0 THEN 3 ELSE 2 END)").alias("kinds"), "before",
    )


def nested(rows: DataFrame) -> DataFrame:
    """`rows` with depth, `group` (position of the bracket whose group a row's kinds belong to) and `wrong` (a closing
    bracket that closes nothing or something else)."""
    opens, closes = F.col("bracket").isin(*OPEN), F.col("bracket").isin(*CLOSE)
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(Window.partitionBy("row").orderBy("pos")))
    at = Window.partitionBy("row", "level").orderBy("pos")
    rows = rows.withColumn("level", F.when(closes, F.col("depth") + 1).otherwise(F.col("depth")))
    # Parentheses right before a brace stand at its own level: two rows before it there is what opened them.
    heads = (F.col("bracket") == "{") & (F.col("before") == ")")
    rows = rows.withColumns({"opened": F.lag("bracket").over(at), "opened_name": F.lag("name").over(at), "head": F.when(heads, F.lag("before", 2).over(at))})
    pair = F.translate("bracket", CLOSE, OPEN)
    wrong = closes & ~((F.col("depth") >= 0) & F.col("opened").eqNullSafe(pair) & F.col("opened_name").eqNullSafe(F.col("name")))
    inside = Window.partitionBy("row", "depth").orderBy("pos")
    return rows.withColumns({"wrong": wrong, "group": F.max(F.when(~closes, F.col("pos"))).over(inside)}).drop("opened", "opened_name", "level")


def contents(rows: DataFrame) -> DataFrame:
    """(row, lang, bracket, before, head, content, wrong) of every group, the groups in it reduced to one letter each."""
    letter = F.translate("bracket", CLOSE, "".join(GROUPS.values()))
    piece = F.when(F.col("bracket").isin(*CLOSE), F.concat(letter, "kinds")).otherwise(F.col("kinds"))
    per = rows.groupBy("row", "lang", "depth", "group").agg(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"), "bracket", "before", F.coalesce("head", F.lit("")).alias("head")))).alias("parts"), F.max("wrong").alias("wrong"),
    )
    return per.select("row", "lang", F.col("parts")[0]["bracket"].alias("bracket"), F.col("parts")[0]["before"].alias("before"), F.col("parts")[0]["head"].alias("head"), F.array_join(F.col("parts")["piece"], "").alias("content"), "wrong")


def _follows(lang: pd.Series, bracket: pd.Series, before: pd.Series, head: pd.Series, content: pd.Series) -> pd.Series:
    known = _follows_known
    out = []
    for key in zip(lang, bracket, before, head, content):
        if (got := known.get(key)) is None:
            got = admissible(*key)
            if len(key[4]) <= 200:
                if len(known) * 200 > REMEMBER:
                    known.clear()
                known[key] = got
        out.append(got)
    return pd.Series(out)


_follows_known: dict[tuple, bool] = {}


def follows() -> Column:
    """Whether the content of a group is admissible."""
    return F.pandas_udf(_follows, "boolean")("lang", "bracket", "before", "head", "content")


def defects(files: DataFrame) -> DataFrame:
    """(file_id, defect) of every file that does not parse; a file may have several defects."""
    spark = files.sparkSession
    tokens = cut(lexed(files))
    table = [(lang, pair) for lang in KEYWORDS for pair in permitted(lang)]
    good = F.broadcast(spark.createDataFrame(table, "lang string, pair string"))  # bounded by the grammars
    found = tokens.where("error is not null").select("file_id", F.concat(F.lit("lexical: "), "error").alias("defect"))
    whole = F.concat(F.lit(START), "kinds", F.lit(END))
    pairs = tokens.where("error is null and kinds <> '' and lang not in ('xml', 'yaml')").select("file_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all(whole, F.lit("(?s)(?=(..))"), F.lit(1)))).alias("pair"))
    found = found.unionByName(pairs.join(good, ["lang", "pair"], "left_anti").select("file_id", F.lit("pair").alias("defect")))
    groups = contents(nested(token_rows(tokens.where("kinds <> ''"))))
    # A group of a file that ends before its bracket closes stays open: there are more opening than closing brackets.
    uneven = F.length(F.regexp_replace("kinds", "[^(\\[{>]", "")) != F.length(F.regexp_replace("kinds", "[^)\\]}<]", ""))
    found = found.unionByName(tokens.where(uneven).select("file_id", F.lit("nesting").alias("defect")))
    judged = groups.withColumn("defect", F.when(F.col("wrong"), "nesting").when(~follows(), "production"))
    bad = judged.where("defect is not null").select("row", "defect").distinct()
    return found.unionByName(tokens.select("row", "file_id").join(bad, "row").select("file_id", "defect")).distinct()


def rates(files: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate) by the language of the path's extension."""
    bad = found.select("file_id").distinct().withColumn("bad", F.lit(1))
    every = files.select("file_id", "repo", language(F.col("path")).alias("language"))
    return (
        every.join(bad, "file_id", "left").groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"))
        .withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
