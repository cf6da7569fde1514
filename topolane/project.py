"""The library as a caller sees it: a project with its graph, the named tools, and the ledger beside it."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolane import INDEX_VERSION
from topolane.functions.text import estimate_tokens, redact_text
from topolane.operators import graph, packet, render, search
from topolane.operators.index import assemble
from topolane.operators.select import select_subgraph
from topolane.sources.extract import fragments
from topolane.sources.git import changed_ranges
from topolane.sources import ledger_file
from topolane.sources.index import IndexStore, diff, report, scan

MAX_INPUT = 10_000
#: Lines of each sort that a packet of at most 2,000 tokens could hold.
MAX_CHANGES = 200


def check_input(value: str, most: int = MAX_INPUT) -> str:
    """Tools take texts that are not blank and not too long."""
    if not value or not value.strip():
        raise ValueError("a value is required")
    if len(value.encode()) > most:
        raise ValueError(f"the value exceeds {most} bytes")
    return value


@dataclass
class Project:
    """Nodes and edges of an index, with the scanned files; every tool gives a DataFrame or a bounded text."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    receipts: dict[str, set[str]] = field(default_factory=dict)
    samples: list[tuple[str, float]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @classmethod
    def index(cls, spark: SparkSession, root: str, store: str | None = None) -> Project:
        """Scan a directory, reuse what a stored index already has (same path, hash and language), and assemble the graph."""
        files = scan(spark, root).withColumn("repo", F.lit(root))
        known = IndexStore(spark, store).load() if store else None
        if known:
            old = known["fragments"].withColumnRenamed("repo", "old_repo")
            same = ["path", "content_hash", "language"]
            kept = old.join(files.select(*same).distinct(), same, "left_semi").withColumnRenamed("old_repo", "repo")
            fresh = fragments(files.join(old.select(*same).distinct(), same, "left_anti").select("repo", "path", "language", "content", "content_hash"))
            frags = kept.select(*fresh.columns).unionByName(fresh)
        else:
            frags = fragments(files.select("repo", "path", "language", "content", "content_hash"))
        nodes, edges = assemble(frags)
        if store:
            IndexStore(spark, store).save(fragments=frags, nodes=nodes, edges=edges, files=files)
        return cls(nodes, edges, files)

    @classmethod
    def sync(cls, spark: SparkSession, root: str, store: str, ledger: str) -> tuple[Project, dict]:
        """Refresh the stored index and write a repository_synced event if anything changed or the ledger is empty."""
        old = IndexStore(spark, store).load()
        p = cls.index(spark, root, store)
        scans = lambda df: df.select("path", "content_hash", F.lit(0).alias("scanned_at"), F.lit(0).alias("file_id"))
        then = scans(old["files"]) if old else scans(p.files).limit(0)
        told = report(diff(then, scans(p.files), ("path",))).first().asDict()
        told |= {"nodes": p.nodes.count(), "edges": p.edges.count()}
        if told["changed"] or told["removed"] or not Path(ledger).exists() or not Path(ledger).stat().st_size:
            ledger_file.append(ledger, [{"type": "repository_synced", "detail": json.dumps(told)}])
        return p, told

    @classmethod
    def open(cls, spark: SparkSession, store: str) -> Project | None:
        """The stored index without a scan."""
        t = IndexStore(spark, store).load()
        return cls(t["nodes"], t["edges"], t["files"]) if t else None

    # -- tools ------------------------------------------------------------------------------------------------------

    def search(self, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        return search.search(self.nodes, check_input(query), kind, limit)

    def callers(self, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
        return search.neighbours(self.edges, self.nodes, search.symbol_nodes(self.nodes, check_input(symbol), file), True, limit)

    def callees(self, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
        return search.neighbours(self.edges, self.nodes, search.symbol_nodes(self.nodes, check_input(symbol), file), False, limit)

    def impact(self, symbol: str, file: str | None = None, depth: int = 2) -> DataFrame:
        """What depends on a symbol, by distance; the symbol itself is left out."""
        roots = search.symbol_nodes(self.nodes, check_input(symbol), file)
        reached = graph.expand(self.edges, roots, max(1, min(depth, 10)))
        return reached.where("distance > 0").join(self.nodes, "node_id").orderBy("distance", "path", "node_id")

    def changes(self, ranges: DataFrame, depth: int = 2, tests: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(directly changed symbols, affected symbols, ranked tests) of ranges (repo, path, first, last)."""
        direct = search.overlapping(self.nodes, ranges)
        reached = graph.expand(self.edges, direct, max(1, min(depth, 10))).where("distance > 0")
        return direct, reached.join(self.nodes, "node_id"), search.ranked_tests(reached, self.nodes).orderBy("distance", "path", "label") if tests else None

    def endpoint(self, symbol: str, file: str | None) -> int:
        """The one node a symbol means; otherwise the candidates are in the error."""
        hit = search.symbol_nodes(self.nodes, check_input(symbol), file).where("kind not in ('import', 'boundary')").orderBy("path", "node_id").limit(21).collect()
        if len(hit) != 1:
            where = ", ".join(f"{r.path}:{r.start_line}" for r in hit[:20])
            raise LookupError(f"{symbol} is ambiguous: {where}" if hit else f"{symbol} is unknown")
        return hit[0].node_id

    def path(self, start: str, goal: str, start_file: str | None = None, goal_file: str | None = None, mode: str = "any", max_hops: int = 8) -> tuple[list, bool]:
        """(up to three shortest paths as (labels, kinds), reversed): if there is none, whether one leads back."""
        a, b = self.endpoint(start, start_file), self.endpoint(goal, goal_file)
        edges, hops = graph.mode_edges(self.edges, mode), max(1, min(max_hops, 20))
        label = dict(self.nodes.select("node_id", "label").join(graph.expand(edges, self.spark.createDataFrame([(a,)], "node_id bigint"), hops, False).select("node_id"), "node_id", "left_semi").collect())
        found = graph.shortest_paths(edges, self.nodes, a, b, hops).collect()
        if found:
            return [([label[n] for n in r.nodes], list(r.kinds)) for r in found], False
        return [], bool(graph.shortest_paths(edges, self.nodes, b, a, hops, 1).collect())

    def node(self, symbol: str, file: str | None = None, line: int | None = None, code: bool = False, limit: int = 12) -> DataFrame:
        hit = search.symbol_nodes(self.nodes, check_input(symbol), file)
        order = [F.abs(F.col("start_line") - line), "node_id"] if line is not None else ["node_id"]
        hit = hit.orderBy(*order).limit(limit)
        hit = hit.join(self.trail(hit, False), "node_id", "left").join(self.trail(hit, True), "node_id", "left").orderBy(*order)
        if not code:
            return hit
        f = self.files.select("repo", "path", "content")
        text = F.when(search.is_config_path(F.col("path")), "[configuration values are withheld]").otherwise(search.source_window(F.col("content"), F.col("start_line"), F.col("end_line"), 240, 12000, 0))
        return hit.join(f, ["repo", "path"], "left").withColumn("source", text).drop("content")

    def trail(self, roots: DataFrame, incoming: bool, most: int = 12) -> DataFrame:
        """(node_id, callers or calls): the first `most` neighbours of each root over execution edges, as "label (path:line)"."""
        a, b = ("dst", "src") if incoming else ("src", "dst")
        near = self.edges.where(graph.is_execution() & (F.col("src") != F.col("dst"))).select(F.col(a).alias("node_id"), F.col(b).alias("other")).distinct()
        near = near.join(roots.select("node_id").distinct(), "node_id", "left_semi")
        told = self.nodes.select(F.col("node_id").alias("other"), F.format_string("%s (%s:%d)", "label", "path", "start_line").alias("at"))
        rank = Window.partitionBy("node_id").orderBy("at")
        near = near.join(told, "other").select("node_id", "at").distinct().withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= most)
        return near.groupBy("node_id").agg(F.array_sort(F.collect_list("at")).alias("callers" if incoming else "calls"))

    def worktree(self) -> DataFrame | None:
        """Changed ranges of the indexed folders that are git work trees; None if there is none."""
        out = None
        for (root,) in self.files.select("repo").distinct().collect():
            try:
                got = changed_ranges(self.spark, root)
            except (OSError, subprocess.CalledProcessError):
                continue
            out = got if out is None else out.unionByName(got)
        return out

    def change_lines(self, ranges: DataFrame) -> list[str]:
        """Changed and affected symbols and ranked tests, a line each."""
        direct, affected, tests = self.changes(ranges)
        at = lambda r: f"{r.label} {r.kind} {r.path}:{r.start_line}-{r.end_line}"
        out = [f"direct {at(r)}" for r in direct.orderBy("path", "start_line", "node_id").limit(MAX_CHANGES).collect()]
        near = affected.where("kind not in ('file', 'import')").orderBy("distance", "path", "start_line", "node_id")
        out += [f"affected {r.distance} {at(r)}" for r in near.limit(MAX_CHANGES).collect()]
        return out + [f"test {r.distance} {r.label} {r.path}" for r in tests.limit(MAX_CHANGES).collect()]

    def file_view(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(symbols of the matching files, files that depend on them)."""
        f = search.matching_files(self.files, check_input(name)).select("repo", "path")
        symbols = self.nodes.where("kind <> 'file'").join(f, ["repo", "path"], "left_semi")
        return symbols, graph.file_dependents(self.nodes, self.edges).join(f, ["repo", "path"], "left_semi")

    def status(self) -> DataFrame:
        kinds = self.nodes.groupBy(F.lit("kind").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        langs = self.files.groupBy(F.lit("language").alias("what"), F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        edges = self.edges.groupBy(F.lit("edge").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        version = self.spark.createDataFrame([("version", "index", INDEX_VERSION)], "what string, name string, n bigint")
        return kinds.unionByName(langs).unionByName(edges).unionByName(version)

    def list_files(self, path: str | None = None, pattern: str | None = None, depth: int | None = None) -> DataFrame:
        from topolane.functions.text import glob_matches

        f = self.files.select("repo", "path", "language", "n_lines")
        if path and (p := path.replace("\\", "/").removeprefix("./").strip("/")):
            f = f.where((F.col("path") == p) | F.col("path").startswith(p + "/"))
        if pattern:
            f = f.where(glob_matches(F.col("path"), pattern))
        if depth is not None:
            f = f.where(F.size(F.split("path", "/")) <= depth)
        n = self.nodes.where("kind <> 'file'").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("symbols"))
        return f.join(n, ["repo", "path"], "left").na.fill(0, ["symbols"]).orderBy("path")

    def explore(self, query: str, max_files: int = 8) -> tuple[DataFrame, DataFrame]:
        """(files by distance with their symbols, relations inside the selection)."""
        chosen, _ = select_subgraph(self.nodes, self.edges, check_input(query), 96)
        rows = chosen.join(self.nodes, "node_id")
        per = rows.where("kind <> 'file'").groupBy("repo", "path").agg(F.min("distance").alias("distance"), F.slice(F.array_sort(F.collect_list(F.struct("start_line", "label"))), 1, 8).alias("symbols"))
        inner = self.edges.where("kind <> 'contains'").join(chosen.select(F.col("node_id").alias("src")), "src", "left_semi").join(chosen.select(F.col("node_id").alias("dst")), "dst", "left_semi")
        return per.orderBy("distance", "path").limit(max(1, min(max_files, 20))), inner.orderBy("src", "dst", "kind").limit(40)

    def selection(self, query: str, max_nodes: int) -> tuple[list[dict], list[tuple[int, int, str]], bool]:
        chosen, truncated = select_subgraph(self.nodes, self.edges, check_input(query), max_nodes)
        rows = [r.asDict() for r in chosen.join(self.nodes, "node_id").orderBy("rank").collect()]
        inner = self.edges.join(chosen.select(F.col("node_id").alias("src")), "src", "left_semi").join(chosen.select(F.col("node_id").alias("dst")), "dst", "left_semi")
        return rows, [(r.src, r.dst, r.kind) for r in inner.select("src", "dst", "kind").collect()], truncated

    def map(self, query: str, max_nodes: int = 48) -> dict:
        """SVG, legend and id of the subgraph of a question."""
        rows, edges, truncated = self.selection(query, max_nodes)
        anchors, relations = render.legend(rows, edges)
        return {"id": render.artifact_id(query), "svg": render.svg(rows, edges), "anchors": anchors, "relations": relations, "truncated": truncated}

    def evidence(self, query: str, projection: str = "", ranges: DataFrame | None = None) -> DataFrame:
        """Records (ord, id, priority, text) that answer a question: state, anchors, changes, relations, source, next step.

        `ranges` is what has changed (repo, path, first, last); without it git says so."""
        from topolane.functions.text import classify_intent

        rows, edges, truncated = self.selection(query, 48)
        intent = self.spark.range(1).select(classify_intent(F.lit(query)).alias("i")).first().i
        anchors = [r for r in rows if r["kind"] != "file"][:12]
        name = {r["node_id"]: f"A{i + 1}" for i, r in enumerate(anchors)}
        out = [("state", 1000, projection)] if projection else []
        out += [(name[r["node_id"]], 900, f"{name[r['node_id']]} {r['label']} {r['kind']} {r['path']}:{r['start_line']}-{r['end_line']}") for r in anchors]
        if intent == "change" and (changed := self.worktree() if ranges is None else ranges) is not None:
            out += [(f"C{i}", 850, f"change {line}") for i, line in enumerate(self.change_lines(changed), 1)]
        if intent in ("flow", "locate", "inspect"):
            out += [(f"{name[a]}-{k}-{name[b]}", 800, f"{name[a]} {k} {name[b]}") for a, b, k in sorted(set(edges)) if a in name and b in name and k != "contains"]
        if intent == "inspect":
            for r in anchors[:3]:
                src = self.node(r["label"], r["path"], r["start_line"], code=True, limit=1).select("source").first()
                out.append((f"S{name[r['node_id']][1:]}", 600, (src.source if src else "") or ""))
        out.append(("next", 100, "narrow the question" if truncated else "inspect an anchor"))
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(out)], "ord int, id string, priority int, text string")

    def context(self, query: str, budget: int = 600, session: str | None = None, full: bool = False, projection: str = "", ranges: DataFrame | None = None) -> dict:
        """One packet under a token budget; with a session only what it has not received yet."""
        budget = max(128, min(budget, 2000))
        rows = self.evidence(query, projection, ranges).withColumn("digest", packet.evidence_digest(F.concat("id", F.lit("\x00"), "text")))
        had = set() if session is None or full else self.receipts.get(session, set())
        if had:
            rows = rows.where(~F.col("digest").isin(*had))
        reserve = 24
        got = [r for r in packet.pack_evidence(rows, [], budget - reserve, ["ord"]).orderBy("rank").collect() if r.kept]
        body = "\n".join(r.text for r in got)
        used = self.spark.range(1).select(estimate_tokens(F.lit(body or " ")).alias("n")).first().n
        header = f"context anchors={sum(r.id.startswith('A') and '-' not in r.id for r in got)} used={used}" if got else "context unchanged"
        if session is not None:
            self.receipts[session] = (set() if full else self.receipts.get(session, set())) | {r.digest for r in got}
        return {"text": header + ("\n" + body if body else ""), "kept": [r.id for r in got], "budget": budget}

    def brief(self, query: str, budget: int = 600, projection: str = "") -> str:
        """Goal, ledger facts, anchors and uncertain boundaries in at most four characters a token."""
        rows, edges, _ = self.selection(query, 48)
        goal = self.spark.range(1).select(redact_text(F.lit(query)).alias("g")).first().g
        uncertain = sorted({r["label"] for r in rows if r["kind"] == "boundary"})
        parts = [f"goal {goal}", projection, *[f"{r['label']} {r['kind']} {r['path']}:{r['start_line']}" for r in rows if r["is_anchor"]][:12], *[f"uncertain {u}" for u in uncertain]]
        text = "\n".join(p for p in parts if p)
        most = budget * 4
        return text if len(text) <= most else text[: max(most - 30, 0)] + "\n[output truncated]"
