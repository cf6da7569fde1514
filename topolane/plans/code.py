"""Queries over the code graph (source_files, file_nodes) and the graph of the relational tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolane.functions import text as X
from topolane.operators import graph, resolve, search
from topolane.operators.index import numbered
from topolane.schemas import OWNER_KINDS
from topolane.session import table

SITE = r"([A-Za-z_][A-Za-z0-9_]*)\("


# ---- the two graphs -------------------------------------------------------------------------------------------------


def file_numbers(files: DataFrame) -> DataFrame:
    """`files` with `file_no`, the upper 32 bits of the ids of a file's nodes: file_id where it has no more bits than that.

    Other file ids are numbered in their order after the greatest that fits, and below 0 once no number above is left,
    so different files never share a number. Positive ids sort like (file_id, local_id) until then.
    """
    inside = F.col("file_id").between(-(1 << 31), (1 << 31) - 1)
    least, most, wide = files.agg(F.min(F.when(inside, F.col("file_id"))), F.max(F.when(inside, F.col("file_id"))), F.count(F.when(~inside, 1))).first()
    if not wide:
        return files.withColumn("file_no", F.col("file_id"))
    first = max(-1 if most is None else most, -1) + 1
    if first + wide - (1 << 32) > (0 if least is None else min(least, 0)):
        raise ValueError("more files than numbers of 32 bits")
    other = numbered(files.where(~inside).select("file_id").distinct(), ["file_id"], "rank", wide // 500_000 + 1)
    no = F.col("rank") + first
    no = F.when(no < 1 << 31, no).otherwise(no - (1 << 32))
    return files.join(other.select("file_id", no.alias("no")), "file_id", "left").withColumn("file_no", F.coalesce("no", "file_id")).drop("no")


def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of the scanned files; nodes of files that are gone are left out, repeated rows are one."""
    return symbol_rows(spark, sf).distinct()


def symbol_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `code_nodes` with their repetitions."""
    repo = file_numbers(table(spark, sf, "source_files").select("file_id", "repo"))
    n = table(spark, sf, "file_nodes").join(repo, "file_id")
    return n.select(
        (F.col("file_no") * 4294967296 + F.col("local_id")).alias("node_id"), "repo", "kind", "label", "qualified_name",
        X.normalize_path(F.col("path")).alias("path"), "start_line", "end_line", "file_id",
        (F.col("file_no") * 4294967296 + F.col("parent_local_id")).alias("parent_id"),
    )


def call_sites(spark: SparkSession, sf: str, nodes: DataFrame) -> DataFrame:
    """Pending `calls` edges: a name before a parenthesis, owned by the innermost function around its line. `nodes` may repeat."""
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n", -1)
    files = table(spark, sf, "source_files").where("content is not null")
    # The names of each line of a file, in its row; `scan` tells rows of one file_id apart.
    files = files.select("file_id", F.col("repo").alias("in_repo"), F.monotonically_increasing_id().alias("scan"), F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(SITE), F.lit(1))).alias("names"))
    spans = nodes.where(F.col("kind").isin(*OWNER_KINDS)).select("file_id", "start_line", "end_line", "node_id", "kind", "label")
    # Names unnested from a well compressed file are far more than its size tells: neither side may be broadcast by that.
    spans = spans.join(files.hint("merge"), "file_id").withColumn("end", F.least("end_line", F.size("names"))).where("start_line <= end and start_line >= 1")
    # The lines of an owner's span that have names, clipped to the file. Rows lie by file_id, so nothing is moved by line.
    at = F.transform(F.sequence("start_line", "end"), lambda x: F.struct(x.alias("line"), F.get("names", x - 1).alias("names")))
    owned = spans.select("file_id", "scan", "start_line", "node_id", "kind", "label", "in_repo", F.explode(F.filter(at, lambda x: F.size(x["names"]) > 0)).alias("s"))
    o = F.struct("start_line", "node_id", "kind", "label", F.col("in_repo").alias("repo"), F.col("s.names").alias("names"))
    owned = owned.groupBy("file_id", "scan", F.col("s.line").alias("line")).agg(F.max(o).alias("o"))
    out = owned.select("line", "o", F.explode("o.names").alias("target_name"))
    out = out.where(~((F.col("line") == F.col("o.start_line")) & (F.col("target_name") == F.col("o.label"))))
    return out.select("o.repo", F.col("o.node_id").alias("source_id"), F.col("o.kind").alias("source_kind"), "target_name", F.lit("calls").alias("kind"), "line")


def resolved_calls(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Calls with what they resolve to; rows: `symbol_rows` if at hand."""
    rows = symbol_rows(spark, sf) if rows is None else rows
    return resolve.resolve(rows.distinct(), call_sites(spark, sf, rows), "simple")


def code_edges(spark: SparkSession, sf: str, nodes: DataFrame, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and boundary nodes of the code graph."""
    resolved = resolve.resolve(nodes, call_sites(spark, sf, nodes), "simple") if resolved is None else resolved
    found, boundaries = resolve.edges_and_boundaries(resolved)
    inside = nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("contains").alias("kind"), F.col("start_line").alias("line"))
    return inside.unionByName(found), boundaries


KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}


def table_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The relational tables as symbols: one kind each, the name as label, kind/key as path."""
    parts = []
    for name, key, label in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", None)):
        k = F.col(key).cast("bigint")
        lab = F.col(label) if label else F.concat(F.lit("Order#"), k.cast("string"))
        parts.append(table(spark, sf, name).select((F.lit(KINDS[name] * 10**12) + k).alias("node_id"), F.lit(name).alias("kind"), lab.alias("label"), F.concat(F.lit(name + "/"), k.cast("string")).alias("path")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"repo": F.lit("tables"), "qualified_name": F.concat_ws("::", "kind", "label"), "start_line": F.lit(1), "end_line": F.lit(1)})


def table_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Foreign keys as edges; parallel edges are kept."""
    ref = lambda kind, col: F.lit(KINDS[kind] * 10**12) + F.col(col).cast("bigint")
    t = lambda name: table(spark, sf, name)
    e = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    return (
        e(t("nation"), ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "contains")
        .unionByName(e(t("customer"), ref("nation", "c_nationkey"), ref("customer", "c_custkey"), "contains"))
        .unionByName(e(t("supplier"), ref("nation", "s_nationkey"), ref("supplier", "s_suppkey"), "contains"))
        .unionByName(e(t("orders"), ref("customer", "o_custkey"), ref("orders", "o_orderkey"), "calls"))
        .unionByName(e(t("lineitem"), ref("orders", "l_orderkey"), ref("part", "l_partkey"), "imports"))
        .unionByName(e(t("lineitem"), ref("orders", "l_orderkey"), ref("supplier", "l_suppkey"), "binds"))
    )


_TABLES = """
tnodes AS (
  SELECT 1000000000000 + r_regionkey AS node_id, 'region' AS kind, r_name AS label, 'region/' || r_regionkey AS path FROM region
  UNION ALL SELECT 2000000000000 + n_nationkey, 'nation', n_name, 'nation/' || n_nationkey FROM nation
  UNION ALL SELECT 3000000000000 + c_custkey, 'customer', c_name, 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 4000000000000 + s_suppkey, 'supplier', s_name, 'supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT 5000000000000 + p_partkey, 'part', p_name, 'part/' || p_partkey FROM part
  UNION ALL SELECT 6000000000000 + o_orderkey, 'orders', 'Order#' || o_orderkey, 'orders/' || o_orderkey FROM orders),
tedges AS (
  SELECT 1000000000000 + n_regionkey AS src, 2000000000000 + n_nationkey AS dst, 'contains' AS kind FROM nation
  UNION ALL SELECT 2000000000000 + c_nationkey, 3000000000000 + c_custkey, 'contains' FROM customer
  UNION ALL SELECT 2000000000000 + s_nationkey, 4000000000000 + s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 3000000000000 + o_custkey, 6000000000000 + o_orderkey, 'calls' FROM orders
  UNION ALL SELECT 6000000000000 + l_orderkey, 5000000000000 + l_partkey, 'imports' FROM lineitem
  UNION ALL SELECT 6000000000000 + l_orderkey, 4000000000000 + l_suppkey, 'binds' FROM lineitem)
"""
_NODES = r"""
nodes AS (
  SELECT DISTINCT f.file_id * 4294967296 + f.local_id AS node_id, s.repo, f.kind, f.label, f.qualified_name,
         trim(regexp_replace(replace(f.path, '\', '/'), '^(\./)+', ''), '/') AS path, f.start_line, f.end_line, f.file_id,
         f.file_id * 4294967296 + f.parent_local_id AS parent_id
  FROM file_nodes f JOIN source_files s ON s.file_id = f.file_id)
"""
_CALLS = (
    _NODES
    + r""",
lines AS (
  SELECT file_id, repo, unnest(t) AS text, unnest(generate_series(1, len(t))) AS line
  FROM (SELECT file_id, repo, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM source_files WHERE content IS NOT NULL)),
sites AS (SELECT file_id, repo, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS target_name FROM lines),
owned AS (
  SELECT l.file_id, l.line, arg_max(n, (n.start_line, n.node_id)) AS o
  FROM lines l JOIN nodes n ON n.file_id = l.file_id AND n.kind IN ('function', 'method', 'kernel') AND l.line BETWEEN n.start_line AND n.end_line
  GROUP BY ALL),
pending AS (
  SELECT s.repo, o.node_id AS source_id, o.kind AS source_kind, s.target_name, s.line
  FROM sites s JOIN owned USING (file_id, line) WHERE NOT (s.line = o.start_line AND s.target_name = o.label)),
defs AS (SELECT repo, node_id, label, lower(label) AS lname FROM nodes WHERE kind IN ('function', 'method', 'kernel', 'class')),
loose AS (SELECT repo, lname, count(*) AS n, min(node_id) AS id FROM defs GROUP BY ALL),
exact AS (SELECT repo, label, count(*) AS n, min(node_id) AS id FROM defs GROUP BY ALL),
resolved AS (
  SELECT p.*, coalesce(e.n, l.n, 0) AS n, CASE WHEN coalesce(e.n, l.n) = 1 THEN coalesce(e.id, l.id) END AS dst
  FROM pending p LEFT JOIN loose l ON l.repo = p.repo AND l.lname = lower(p.target_name)
  LEFT JOIN exact e ON e.repo = p.repo AND e.label = p.target_name)
"""
)

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


# ---- counts and checks ----------------------------------------------------------------------------------------------


@query("WITH " + _NODES + "SELECT repo, kind, count(*) AS n FROM nodes GROUP BY ALL")
def graph_nodes_by_kind(spark, sf):
    return code_nodes(spark, sf).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _CALLS + "SELECT CASE WHEN n = 1 THEN 'calls' ELSE 'uncertain_calls' END AS kind, count(*) AS n FROM resolved WHERE n > 0 GROUP BY 1 UNION ALL SELECT 'contains', count(*) FROM nodes WHERE parent_id IS NOT NULL")
def graph_edges_by_kind(spark, sf):
    rows = symbol_rows(spark, sf)
    return code_edges(spark, sf, rows.distinct(), resolved_calls(spark, sf, rows))[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _TABLES + ", n AS (SELECT node_id, count(*) c FROM tnodes GROUP BY 1) SELECT 'repeated_id' AS problem, count(*) AS n FROM n WHERE c > 1 UNION ALL SELECT 'missing_end', count(*) FROM (SELECT unnest([src, dst]) AS id FROM tedges) WHERE id NOT IN (SELECT node_id FROM tnodes)")
def graph_validate(spark, sf):
    return graph.validate(table_nodes(spark, sf), table_edges(spark, sf))


@query("WITH " + _TABLES + "SELECT id AS node_id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM tedges UNION ALL SELECT dst, 0, 1 FROM tedges) GROUP BY 1 ORDER BY degree DESC, node_id LIMIT 50")
def graph_degree_topk(spark, sf):
    return graph.degrees(table_edges(spark, sf)).orderBy(F.col("degree").desc(), "node_id").limit(50)


@query(r"WITH f AS (SELECT lower(regexp_extract(path, '\.([^./\\]+)$', 1)) AS extension, count(*) AS files, sum(n_lines)::BIGINT AS lines, sum(strlen(content))::BIGINT AS bytes FROM source_files GROUP BY 1) SELECT * FROM f")
def status_languages(spark, sf):
    f = table(spark, sf, "source_files")
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return f.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_lines").alias("lines"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


# ---- resolution -----------------------------------------------------------------------------------------------------


@query("WITH " + _CALLS + "SELECT repo, CASE WHEN n = 1 THEN 'edge' WHEN n > 1 THEN 'boundary' ELSE 'dropped' END AS outcome, count(*) AS n FROM resolved GROUP BY ALL")
def resolve_outcomes(spark, sf):
    return resolved_calls(spark, sf).groupBy("repo", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _CALLS + "SELECT source_id, target_name, line, dst FROM resolved WHERE n = 1")
def resolve_unique(spark, sf):
    return resolved_calls(spark, sf).where("outcome = 'edge'").select("source_id", "target_name", "line", "dst")


@query("WITH " + _CALLS + "SELECT repo, '?' || target_name AS label, count(*) AS sites, min(n)::BIGINT AS candidates FROM resolved WHERE n > 1 GROUP BY ALL")
def resolve_ambiguous_boundary(spark, sf):
    hit = resolved_calls(spark, sf).where("outcome = 'boundary'")
    return hit.groupBy("repo", F.concat(F.lit("?"), "target_name").alias("label")).agg(F.count(F.lit(1)).alias("sites"), F.min("n").alias("candidates"))


@query("WITH " + _NODES + """, q AS (SELECT repo, node_id, lower(qualified_name) AS q FROM nodes WHERE qualified_name LIKE '%::%'),
p AS (SELECT n.node_id AS source_id, n.repo, n.qualified_name AS target_name FROM nodes n WHERE n.kind = 'method' AND n.qualified_name LIKE '%::%')
SELECT p.source_id, p.target_name, count(*) AS n FROM p JOIN nodes d ON d.repo = p.repo
 AND d.kind IN ('file','module','class','struct','enum','interface','trait','type_alias','function','method','kernel','component')
 AND d.qualified_name LIKE '%::%' AND (lower(d.qualified_name) = lower(p.target_name) OR ends_with(lower(d.qualified_name), '::' || lower(p.target_name))) GROUP BY ALL""")  # fmt: skip
def resolve_suffix(spark, sf):
    n = code_nodes(spark, sf)
    p = n.where("kind = 'method' and instr(qualified_name, '::') > 0").select("repo", F.col("node_id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("qualified_name").alias("target_name"), F.lit("references").alias("kind"), F.col("start_line").alias("line"))
    return resolve.resolve(n, p, "qualified").where("n > 0").select("source_id", "target_name", "n")


# ---- search and navigation ------------------------------------------------------------------------------------------

_TIER = "CASE WHEN lower(label) = 'ledger' THEN 0 WHEN starts_with(lower(label), 'ledger') THEN 1 WHEN contains(lower(label), 'ledger') THEN 2 WHEN contains(lower(coalesce(qualified_name, '')), 'ledger') THEN 3 WHEN contains(lower(path), 'ledger') THEN 4 END"


@query("WITH " + _NODES + f"SELECT node_id, label, tier FROM (SELECT *, {_TIER} AS tier FROM nodes WHERE kind <> 'file') WHERE tier IS NOT NULL ORDER BY tier, path, node_id LIMIT 100")
def search_tiers(spark, sf):
    return search.search(code_nodes(spark, sf), "ledger", limit=100).select("node_id", "label", "tier")


@query("WITH " + _NODES + f"SELECT node_id, label, tier FROM (SELECT *, {_TIER} AS tier FROM nodes WHERE kind = 'class') WHERE tier IS NOT NULL ORDER BY tier, path, node_id LIMIT 20")
def search_kind_filter(spark, sf):
    return search.search(code_nodes(spark, sf), "ledger", "class", 20).select("node_id", "label", "tier")


@query("WITH " + _NODES + "SELECT node_id, label, path FROM nodes WHERE kind <> 'file' AND (lower(label) = 'group_lane' OR lower(coalesce(qualified_name, '')) = 'group_lane' OR ends_with(lower(coalesce(qualified_name, '')), '::group_lane'))")
def node_by_symbol(spark, sf):
    return search.symbol_nodes(code_nodes(spark, sf), "group_lane").select("node_id", "label", "path")


@query("WITH " + _TABLES + "SELECT e.src AS node_id, n.label, n.path, min(e.kind) AS edge_kind FROM tedges e JOIN tnodes n ON n.node_id = e.src WHERE e.dst = 4000000000001 AND e.kind IN ('calls', 'launches', 'routes_to', 'binds', 'renders') GROUP BY ALL")
def callers_of(spark, sf):
    n = table_nodes(spark, sf)
    roots = n.where("path = 'supplier/1'")
    return search.neighbours(table_edges(spark, sf), n, roots, True, None).select("node_id", "label", "path", "edge_kind")


@query("WITH " + _TABLES + "SELECT e.dst AS node_id, n.label, n.path, min(e.kind) AS edge_kind FROM tedges e JOIN tnodes n ON n.node_id = e.dst WHERE e.src = 3000000000001 AND e.kind IN ('calls', 'launches', 'routes_to', 'binds', 'renders') GROUP BY ALL")
def callees_of(spark, sf):
    n = table_nodes(spark, sf)
    return search.neighbours(table_edges(spark, sf), n, n.where("path = 'customer/1'"), False, None).select("node_id", "label", "path", "edge_kind")


@query("WITH RECURSIVE " + _TABLES + """, reach AS (SELECT 5000000000001 AS node_id, 0 AS distance
  UNION SELECT e.src, r.distance + 1 FROM reach r JOIN tedges e ON e.dst = r.node_id AND e.kind <> 'contains' WHERE r.distance < 3)
SELECT node_id, min(distance) AS distance FROM reach GROUP BY 1""")
def impact_levels(spark, sf):
    seeds = table_nodes(spark, sf).where("path = 'part/1'").select("node_id")
    return graph.expand(table_edges(spark, sf), seeds, 3)


@query("WITH RECURSIVE " + _TABLES + """, goal AS (SELECT 4000000000000 + min(l_suppkey) AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 1), walk AS (
  SELECT [3000000000001] AS nodes, []::VARCHAR[] AS kinds, []::VARCHAR[] AS ord, 3000000000001 AS tip
  UNION ALL SELECT list_append(w.nodes, e.dst), list_append(w.kinds, e.kind), w.ord || [n.path, n.label, e.kind], e.dst
  FROM walk w JOIN tedges e ON e.src = w.tip AND e.kind <> 'contains' JOIN tnodes n ON n.node_id = e.dst WHERE NOT list_contains(w.nodes, e.dst) AND len(w.kinds) < 8),
hit AS (SELECT walk.*, len(kinds) AS hops FROM walk, goal WHERE tip = g),
best AS (SELECT * FROM hit WHERE hops = (SELECT min(hops) FROM hit) ORDER BY ord LIMIT 3)
SELECT row_number() OVER (ORDER BY ord) AS path_no, hops::INT AS hops, array_to_string(nodes, '>') AS nodes, array_to_string(kinds, '>') AS kinds FROM best""")  # fmt: skip
def path_shortest_k(spark, sf):
    """Shortest paths from customer 1 to the smallest supplier of their orders (one row, looked up first)."""
    mine = table(spark, sf, "orders").where("o_custkey = 1").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    goal = mine.agg(F.min("l_suppkey")).first()[0]
    p = graph.shortest_paths(table_edges(spark, sf), table_nodes(spark, sf), 3000000000001, 4000000000000 + (goal or 0))
    return p.select(F.col("path_no").cast("bigint"), "hops", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"), F.array_join("kinds", ">").alias("kinds"))


@query("WITH " + _CALLS + ", e AS (SELECT source_id AS src, dst FROM resolved WHERE n = 1) SELECT DISTINCT b.repo, b.path, a.path AS dependent FROM e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE a.path <> b.path")
def file_dependents(spark, sf):
    # Only what resolves to one definition can be an edge into a file; boundaries have none and are not moved.
    rows = symbol_rows(spark, sf)
    found = resolved_calls(spark, sf, rows).where("outcome = 'edge'")
    return graph.file_dependents(rows.distinct(), found.select(F.col("source_id").alias("src"), "dst", F.col("edge_kind").alias("kind")))


@query("WITH " + _NODES + ", r AS (SELECT DISTINCT repo, path, greatest(n_lines // 2, 1) AS lo, greatest(n_lines // 2, 1) + 2 AS hi FROM source_files) SELECT DISTINCT n.node_id, n.kind FROM nodes n JOIN r ON r.repo = n.repo AND r.path = n.path WHERE n.kind <> 'file' AND n.start_line <= r.hi AND n.end_line >= r.lo")
def changes_overlap(spark, sf):
    mid = F.greatest(F.floor(F.col("n_lines") / 2).cast("int"), F.lit(1))
    ranges = table(spark, sf, "source_files").select("repo", "path", mid.alias("first"), (mid + 2).alias("last")).distinct()
    return search.overlapping(code_nodes(spark, sf), ranges).select("node_id", "kind")


@query("WITH " + _NODES + r", f AS (SELECT DISTINCT repo, path FROM source_files WHERE regexp_matches(path, '^(?:.*/)?[^/]*ledger[^/]*\.[^/][^/]$')) SELECT f.repo, f.path, count(n.node_id) AS symbols FROM f LEFT JOIN nodes n ON n.repo = f.repo AND n.path = f.path AND n.kind <> 'file' GROUP BY ALL")
def files_glob(spark, sf):
    f = table(spark, sf, "source_files").select("repo", "path").distinct().where(X.glob_matches(F.col("path"), "**/*ledger*.??"))
    n = code_nodes(spark, sf).where("kind <> 'file'").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("k"))
    return f.join(n, ["repo", "path"], "left").select("repo", "path", F.coalesce("k", F.lit(0)).alias("symbols"))


@query("SELECT repo, split_part(path, '/', 1) AS top, count(DISTINCT path) AS files, sum(n_lines)::BIGINT AS lines FROM source_files GROUP BY ALL")
def files_grouped(spark, sf):
    f = table(spark, sf, "source_files")
    return f.groupBy("repo", F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).agg(F.countDistinct("path").alias("files"), F.sum("n_lines").alias("lines"))


@query(r"""SELECT DISTINCT path, trim(regexp_replace(replace(path, '\', '/'), '^(\./)+', ''), '/') AS normal FROM file_nodes""")
def normalize_path(spark, sf):
    return table(spark, sf, "file_nodes").select("path", X.normalize_path(F.col("path")).alias("normal")).distinct()


@query("WITH " + _NODES + r""", w AS (SELECT n.node_id, greatest(n.start_line - 2, 1) AS lo, least(n.end_line + 2 - greatest(n.start_line - 2, 1) + 1, 12, len(t) - greatest(n.start_line - 2, 1) + 1) AS k, t
  FROM nodes n JOIN (SELECT file_id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM source_files WHERE content IS NOT NULL) s USING (file_id) WHERE n.kind = 'class')
SELECT node_id, substring(CASE WHEN k > 0 THEN array_to_string([(lo + i) || ' | ' || t[lo + i] FOR i IN generate_series(0, k - 1)], chr(10)) ELSE '' END, 1, 700) AS source FROM w""")  # fmt: skip
def source_window(spark, sf):
    n = code_nodes(spark, sf).where("kind = 'class'")
    f = table(spark, sf, "source_files").select("file_id", "content").where("content is not null")
    return n.join(f.hint("merge"), "file_id").select("node_id", search.source_window(F.col("content"), F.col("start_line"), F.col("end_line"), 12, 700).alias("source"))


@query()
def source_windows(spark, sf):
    """Windows of all symbols with the production limits of the operator; those of configuration files are withheld."""
    n = code_nodes(spark, sf).where("kind <> 'file'")
    f = table(spark, sf, "source_files").select("file_id", "content").where("content is not null")
    text = F.when(search.is_config_path(F.col("path")), "[configuration values are withheld]").otherwise(search.source_window(F.col("content"), F.col("start_line"), F.col("end_line")))
    return n.join(f.hint("merge"), "file_id").select("node_id", text.alias("source"))


@query("WITH " + _NODES + ", h AS (SELECT DISTINCT node_id, start_line AS first, end_line - start_line + 1 AS size FROM nodes) SELECT node_id, first, first + greatest(size, 1) - 1 AS last FROM h")
def hunk_parse(spark, sf):
    n = code_nodes(spark, sf)
    head = F.format_string("@@ -1,0 +%d,%d @@ x", "start_line", F.col("end_line") - F.col("start_line") + 1)
    return n.select("node_id", F.explode(search.parse_hunks(head)).alias("h")).select("node_id", "h.first", "h.last")


@query("WITH " + _NODES + r"""SELECT DISTINCT label, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(label, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: lower(x)), lambda x: x <> ''), ' ') AS words FROM nodes""")
def identifier_words(spark, sf):
    return code_nodes(spark, sf).select("label", F.array_join(X.identifier_words(F.col("label")), " ").alias("words")).distinct()


@query("WITH " + _NODES + "SELECT repo, count(DISTINCT CASE WHEN c = 2 THEN label END) AS shared, count(DISTINCT CASE WHEN c = 1 AND p THEN label END) AS only_functions, count(DISTINCT CASE WHEN c = 1 AND NOT p THEN label END) AS only_methods FROM (SELECT repo, label, count(DISTINCT kind) AS c, bool_or(kind = 'function') AS p FROM nodes WHERE kind IN ('function', 'method') GROUP BY ALL) GROUP BY 1")
def label_set_compare(spark, sf):
    """Intersection and differences of two label sets of each repository."""
    n = code_nodes(spark, sf).where("kind in ('function', 'method')")
    per = n.groupBy("repo", "label").agg(F.max(F.when(F.col("kind") == "function", 1).otherwise(0)).alias("f"), F.max(F.when(F.col("kind") == "method", 1).otherwise(0)).alias("m"))
    return per.groupBy("repo").agg(
        F.count(F.when((F.col("f") == 1) & (F.col("m") == 1), 1)).alias("shared"), F.count(F.when((F.col("f") == 1) & (F.col("m") == 0), 1)).alias("only_functions"),
        F.count(F.when((F.col("f") == 0) & (F.col("m") == 1), 1)).alias("only_methods"),
    )


@query("""WITH s AS (SELECT repo, path, content_hash, scanned_at, file_id FROM source_files), cutoff AS (SELECT TIMESTAMP '2026-03-01' AS t),
o AS (SELECT repo, path, arg_max(content_hash, (scanned_at, file_id)) AS h FROM s, cutoff WHERE scanned_at < t GROUP BY ALL),
n AS (SELECT repo, path, arg_max(content_hash, (scanned_at, file_id)) AS h FROM s, cutoff WHERE scanned_at >= t GROUP BY ALL)
SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state
FROM o FULL OUTER JOIN n ON o.repo = n.repo AND o.path = n.path""")  # fmt: skip
def fragment_diff(spark, sf):
    """Scans before a date against those after it."""
    from topolane.sources.index import diff

    f = table(spark, sf, "source_files")
    early, late = f.where("scanned_at < timestamp '2026-03-01'"), f.where("scanned_at >= timestamp '2026-03-01'")
    return diff(early, late).select("repo", "path", "state")


@query("SELECT file_id, true AS same FROM source_files WHERE content IS NOT NULL")
def content_hash_parity(spark, sf):
    from topolane.sources.index import fnv1a64

    return table(spark, sf, "source_files").where("content is not null").select("file_id", (fnv1a64(F.col("content")) == F.col("content_hash")).alias("same"))
