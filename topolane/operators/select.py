"""Concept-ranked subgraph: term groups, scores, anchors, connectors, expansion.

Scoring is one pass of column expressions over the nodes; only the best few rows of each group (12 times the groups at most)
come to the driver for the round-robin, whose result is bounded by 12 anchors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolane.functions.text import ascii_lower, identifier_words
from topolane.operators.graph import degrees, weighted_distances

#: Words that carry no concept.
STOP_WORDS = (
    "a an and are be become by collect do does eventually editor for from get gets how in into is of on reach reaches rest the through to use used using what where with"
).split()
#: Other names of a concept.
ALIASES = {
    "argument": ("arg", "args", "cli"), "arguments": ("arg", "args", "cli"), "command": ("cli",), "configuration": ("config", "configure"), "configured": ("config", "configure"),
    "directory": ("dir",), "directories": ("dir",), "dispatch": ("dispatcher", "route"), "dispatched": ("dispatcher", "route"), "register": ("registration",),
    "registered": ("registration",), "scheduler": ("schedule",), "spawn": ("spawner",), "spawned": ("spawner",),
}
SUFFIXES = ("ation", "ing", "ion", "ed", "es", "s")
FLOW_PHRASES = (" reach ", " flow ", " become ", " collect ", " enter ")
NOT_SYMBOLS = ("file", "import", "boundary")


@dataclass
class Query:
    """What a question asks for, worked out on the driver (at most some fifty words)."""

    groups: list[list[str]] = field(default_factory=list)
    flow: bool = False
    with_tests: bool = False


def variants(word: str) -> list[str]:
    """The word, its stem, other names of it, and its plural."""
    out = [word]
    for s in SUFFIXES:
        if word.endswith(s) and len(word) > len(s) + 3:
            stem = word[: -len(s)]
            out.append(stem)
            if s in ("ation", "ing", "ed") and stem[-1:] != "e":
                out.append(stem + "e")
            break
    out += ALIASES.get(word, ())
    if len(word) > 3 and word[-1] != "s":
        out.append(word + "s")
    return out


def understand(question: str) -> Query:
    low = question.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    plain = low
    for a, b in (("command-line", "cli"), ("command line", "cli"), ("high-level", ""), ("high level", "")):
        plain = plain.replace(a, b)
    words = [w.strip("_") for w in re.split(r"[^\w]+", plain)]
    groups: list[set[str]] = []
    for w in words:
        if len(w.encode()) <= 1 or w in STOP_WORDS:
            continue
        mine = set(variants(w))
        apart = [g for g in groups if not g & mine]
        for g in groups:
            if g & mine:
                mine |= g
        groups = [*apart, mine]
    flat = {w for g in groups for w in g}
    return Query(
        sorted(sorted(g) for g in groups), low.startswith("how ") or any(p in low for p in FLOW_PHRASES), bool(flat & {"test", "tests", "example", "examples", "bench"})
    )


def is_non_production(path: Column) -> Column:
    return path.rlike(r"^[^/]*-tests?(/|$)|(^|/)(tests|examples|benches)/|/test/|/(tests|test|testutil|test_util|test_utils|build)\.rs$|^build\.rs$")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\.rs$", 1)


def term_score(term: str) -> Column:
    """Score of one term against the columns l (label), lw (its words), q (qualified name), qw, p (path), stem; the first rule that applies."""
    t, n = F.lit(term), len(term.encode())
    near = F.exists("lw", lambda w: F.lit(n >= 3) & (F.octet_length(w) >= 3) & (w.startswith(t) | t.startswith(w)))
    return (
        F.when(F.col("l") == t, 160).when(F.array_contains("lw", term), 100).when(F.col("q").endswith(t), 90).when(F.array_contains("qw", term), 85)
        .when(F.col("l").contains(t), 60).when(near, 35).when(F.col("stem") == t, 55)
        .when((F.col("stem") != "") & F.lit(n >= 4) & (F.col("stem").startswith(t) | t.startswith(F.col("stem"))), 35)
        .when(F.col("q").contains(t), 25).when(F.col("p").contains(t), 10).otherwise(0)
    )


def once(df: DataFrame, *cols: Column) -> DataFrame:
    """`df` with further columns, worked out once a row: a filter above reads them, it would otherwise work them out anew wherever it names them."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def _many(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def scores(nodes: DataFrame, edges: DataFrame, q: Query) -> DataFrame:
    """(node_id, group, score, owner) of every candidate of every group."""
    low = lambda c: F.coalesce(ascii_lower(F.col(c)), F.lit(""))
    n = nodes.where(~F.col("kind").isin(*NOT_SYMBOLS)).select("node_id", "kind", low("label").alias("l"), low("qualified_name").alias("q"), low("path").alias("p"), "label", "qualified_name")
    if not q.with_tests:
        n = n.where(~is_non_production(F.col("p")))
    words_of = lambda c: identifier_words(F.coalesce(c, F.lit("")))
    n = once(n, words_of("label").alias("lw"), words_of("qualified_name").alias("qw"), _stem(F.col("p")).alias("stem"))
    # Nodes that no term touches can be no candidates; they leave before the join with the degrees.
    n = n.withColumn("gs", F.array(*[_many([term_score(t) for t in g]) for g in q.groups]))
    n = n.withColumn("lexical", F.aggregate("gs", F.lit(0), lambda a, x: a + x)).where("lexical > 0")
    n = n.join(degrees(edges).select("node_id", "degree"), "node_id", "left")
    flat = F.array(*[F.lit(w) for g in q.groups for w in g])
    strong = F.size(F.filter("gs", lambda x: x >= 35))
    named = F.arrays_overlap("lw", flat)
    owned = F.size(F.array_except(F.array_intersect("qw", flat), "lw")) > 0
    callable_ = F.col("kind").isin("function", "method")
    owner = F.when(F.lit(q.flow) & named & owned, 220 - F.least(F.greatest(F.size("lw") - 1, F.lit(0)), F.lit(2)) * 80).otherwise(0)
    kind = F.when(callable_, 68 if q.flow else 8).when(F.col("kind").isin("struct", "trait", "impl"), 8).otherwise(0)
    inside = F.when(F.col("p").startswith("src/") | F.col("p").contains("/src/"), 20).otherwise(0)
    base = F.col("lexical") + kind + inside + F.least(F.coalesce("degree", F.lit(0)), F.lit(20))
    words = identifier_words(F.col("l"))
    affinity = (
        F.when((F.col("stem") == F.col("l")) | F.array_contains(words, F.col("stem")), 50)
        .when((F.octet_length("stem") >= 4) & F.exists(words, lambda w: w.startswith(F.col("stem")) | F.col("stem").startswith(w)), 35).otherwise(0)
    )
    first = F.regexp_extract("p", r"([^/.]*)[^/]*$", 1)
    public = F.when(~F.col("kind").isin("function", "method", "route", "component"), 0).when(first.isin("lib", "mod", "index", "api", "router", "routes"), 100).when(F.col("p").rlike("/api/|/routes/"), 60).otherwise(0)
    common = affinity + public + F.when(F.lit(q.flow) & callable_, 150).otherwise(0) + F.greatest(strong - 1, F.lit(0)) * 100 + owner + F.floor(base / 10).cast("int")
    groups = F.array(*[F.array(*[F.lit(w) for w in g]) for g in q.groups])
    whose = F.regexp_extract("qualified_name", r"^(.*)::[^:]*$", 1)
    whose = F.lower(F.trim(F.split_part(F.regexp_replace(whose, "^impl ", ""), F.lit("<"), F.lit(1))))
    out = n.select("node_id", "lw", common.alias("common"), whose.alias("owner"), F.posexplode("gs").alias("group", "g")).where("g >= 35")
    compound = F.greatest(F.size(F.filter("lw", lambda w: F.array_contains(F.element_at(groups, F.col("group") + 1), w))) - 1, F.lit(0)) * 80
    return out.select("node_id", "group", (F.col("g") + F.col("common") + compound).cast("int").alias("score"), "owner")


def pick(rows: list[tuple[int, int, int, str]], limit: int) -> list[int]:
    """Anchors by turns: the best candidate of each group, then the second ones; at most two of an owner."""
    by: dict[int, list] = {}
    for node, group, score, owner in rows:
        by.setdefault(group, []).append((-score, node, owner))
    lists = sorted(sorted(v) for v in by.values())
    out: list[int] = []
    owners: dict[str, int] = {}
    turn = 0
    while len(out) < limit:
        before = len(out)
        for candidates in lists:
            if turn >= len(candidates):
                continue
            _, node, owner = candidates[turn]
            if node in out or (owner and owners.get(owner, 0) >= 2):
                continue
            out.append(node)
            if owner:
                owners[owner] = owners.get(owner, 0) + 1
            if len(out) == limit:
                break
        if len(out) == before:
            break
        turn += 1
    return out


def connectors(nodes: DataFrame, edges: DataFrame, anchors: list[int], room: int, with_tests: bool, mend_uncertain: bool = False) -> list[int]:
    """Neighbours that explain the anchors best: callers before callees before implementations."""
    near = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("o"), F.lit(False).alias("inc")), F.struct(F.col("dst").alias("a"), F.col("src").alias("o"), F.lit(True).alias("inc")))).alias("e"), "kind")
    near = near.select("e.*", F.col("kind").alias("edge")).where(F.col("a").isin(anchors) & ~F.col("o").isin(anchors))
    worth = F.when((F.col("edge") == "calls") & F.col("inc"), 100).when(F.col("edge") == "calls", 60).when(F.col("edge") == "implements", 50)
    if mend_uncertain:
        worth = worth.when((F.col("edge") == "uncertain_calls") & F.col("inc"), 70).when(F.col("edge") == "uncertain_calls", 10)
    near = near.withColumn("worth", worth).where("worth is not null").join(nodes.select(F.col("node_id").alias("o"), "kind", "path"), "o").where(~F.col("kind").isin(*NOT_SYMBOLS))
    if not with_tests:
        near = near.where(~is_non_production(F.col("path")))
    kind = F.when(F.col("kind").isin("function", "method"), 15).when(F.col("kind").isin("struct", "trait", "impl"), 8).otherwise(0)
    return [r[0] for r in near.groupBy("o").agg(F.sum(F.col("worth") + kind).alias("s")).orderBy(F.col("s").desc(), "o").limit(room).collect()]


def anchors_of(nodes: DataFrame, edges: DataFrame, q: Query, max_nodes: int) -> list[int]:
    limit = min(max_nodes, 12)
    spare = 2 if limit >= 8 and len(q.groups) <= 4 else 0
    picked: list[int] = []
    if q.groups:
        w = Window.partitionBy("group").orderBy(F.col("score").desc(), "node_id")
        best = scores(nodes, edges, q).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 12 * len(q.groups) + 12)
        picked = pick([(r.node_id, r.group, r.score, r.owner) for r in best.collect()], limit - spare)
    if spare and picked:
        picked += connectors(nodes, edges, picked, limit - len(picked), q.with_tests)
    return picked or [r[0] for r in nodes.where("kind = 'file'").orderBy("node_id").limit(12).select("node_id").collect()]


def select_subgraph(nodes: DataFrame, edges: DataFrame, question: str, max_nodes: int = 48) -> tuple[DataFrame, bool]:
    """(selection(node_id, rank, distance, is_anchor), truncated): the nodes nearest to the anchors of a question.

    Containment counts as an edge here, with weight 2. Uncertain edges weigh 2 like others; `weighted_distances` takes another weight.
    """
    spark = nodes.sparkSession
    most = max(1, min(max_nodes, 96))
    q = understand(question)
    anchors = anchors_of(nodes, edges, q, most)
    if not anchors:
        return spark.createDataFrame([], "node_id bigint, rank int, distance int, is_anchor boolean"), False
    seeds = spark.createDataFrame([(a,) for a in anchors], "node_id bigint")
    reached = weighted_distances(edges, seeds, most)
    top = reached.orderBy("distance", "node_id").limit(most + 1).collect()
    rows = [(r.node_id, i, r.distance, r.node_id in set(anchors)) for i, r in enumerate(top[:most])]
    return spark.createDataFrame(rows, "node_id bigint, rank int, distance int, is_anchor boolean"), len(top) > most
