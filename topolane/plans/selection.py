"""Queries of extraction and concept-ranked selection over the scanned files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolane.functions.text import ascii_lower, identifier_words
from topolane.operators import render, select
from topolane.operators.index import assemble
from topolane.plans.code import _NODES, code_edges, code_nodes
from topolane.session import cut, table
from topolane.sources.extract import flat_nodes, fragments
from topolane.sources.index import language_of

QUESTION = "How does the ledger reach a packet window?"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return take


def _words(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: lower(x)), lambda x: x <> '')"


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = cut(code_nodes(spark, sf))
    edges, boundaries = code_edges(spark, sf, n)
    more = boundaries.select("node_id", "repo", "kind", "label", F.lit(None).cast("string").alias("qualified_name"), F.lit(None).cast("string").alias("path"), F.col("line").alias("start_line"), F.col("line").alias("end_line")).distinct()
    return n.select(*more.columns).unionByName(more), cut(edges)


@query("WITH " + _NODES + f""", w AS (SELECT node_id, lower(label) AS l, {_words('label')} AS lw, lower(coalesce(qualified_name, '')) AS q, {_words("coalesce(qualified_name, '')")} AS qw, lower(path) AS p, regexp_extract(lower(path), '([^/]*)\\.rs$', 1) AS stem FROM nodes WHERE kind NOT IN ('file', 'import', 'boundary')),
s AS (SELECT node_id, CASE WHEN l = 'ledger' THEN 160 WHEN list_contains(lw, 'ledger') THEN 100 WHEN ends_with(q, 'ledger') THEN 90 WHEN list_contains(qw, 'ledger') THEN 85 WHEN contains(l, 'ledger') THEN 60
 WHEN len(list_filter(lw, lambda x: strlen(x) >= 3 AND (starts_with(x, 'ledger') OR starts_with('ledger', x)))) > 0 THEN 35 WHEN stem = 'ledger' THEN 55
 WHEN stem <> '' AND (starts_with(stem, 'ledger') OR starts_with('ledger', stem)) THEN 35 WHEN contains(q, 'ledger') THEN 25 WHEN contains(p, 'ledger') THEN 10 ELSE 0 END AS score FROM w)
SELECT node_id, score FROM s WHERE score > 0""")  # fmt: skip
def select_term_scores(spark, sf):
    """Score of one term against every symbol."""
    low = lambda c: F.coalesce(ascii_lower(F.col(c)), F.lit(""))
    n = code_nodes(spark, sf).where(~F.col("kind").isin(*select.NOT_SYMBOLS))
    n = n.select("node_id", low("label").alias("l"), low("qualified_name").alias("q"), low("path").alias("p"), "label", "qualified_name")
    n = select.once(n, identifier_words(F.col("label")).alias("lw"), identifier_words(F.coalesce("qualified_name", F.lit(""))).alias("qw"), select._stem(F.col("p")).alias("stem"))
    return n.select("node_id", select.term_score("ledger").alias("score")).where("score > 0")


@query()
def select_scores(spark, sf):
    nodes, edges = _graph(spark, sf)
    return select.scores(nodes, edges, select.understand(QUESTION))


@query()
def select_expand(spark, sf):
    nodes, edges = _graph(spark, sf)
    return select.select_subgraph(nodes, edges, QUESTION, 48)[0]


@query()
def map_svg(spark, sf):
    """The picture of a question's subgraph (at most 96 nodes are drawn, on the driver)."""
    nodes, edges = _graph(spark, sf)
    chosen, truncated = select.select_subgraph(nodes, edges, QUESTION, 48)
    rows = [r.asDict() for r in chosen.join(nodes, "node_id").orderBy("rank").collect()]
    inside = edges.join(chosen.select(F.col("node_id").alias("src")), "src", "left_semi").join(chosen.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    links = [(r.src, r.dst, r.kind) for r in inside.select("src", "dst", "kind").collect()]
    svg = render.svg(rows, links)
    return spark.createDataFrame([(render.artifact_id(QUESTION), svg, len(rows), truncated)], "id string, svg string, nodes int, truncated boolean")


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "source_files").where("content is not null")
    return fragments(f.select("file_id", "repo", "path", language_of(F.col("path")).alias("language"), "content", "content_hash"))


@query()
def extract_symbols(spark, sf):
    """Symbols by language and kind as the scanners find them."""
    return flat_nodes(_fragments(spark, sf), ["file_id", "language"]).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def extract_recall(spark, sf):
    """Share of the recorded symbols that the scanners find again, by kind."""
    found = flat_nodes(_fragments(spark, sf), ["file_id"]).select("file_id", "kind", "label").distinct().withColumn("hit", F.lit(1))
    truth = table(spark, sf, "file_nodes").join(table(spark, sf, "source_files").where("content is not null").select("file_id"), "file_id", "left_semi").select("file_id", "kind", "label").distinct()
    return truth.join(found, ["file_id", "kind", "label"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"), F.count("hit").alias("found"))


@query()
def index_assembled(spark, sf):
    """Edges by kind of the graph that extraction and resolution give for all scanned files."""
    latest = _fragments(spark, sf).drop("file_id").dropDuplicates(["repo", "path"])
    return assemble(latest)[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
