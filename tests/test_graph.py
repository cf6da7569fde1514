import random
from collections import defaultdict, deque

from topolane.operators import graph, render, resolve, search, select


def edges_df(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint, kind string")


def test_expand_against_breadth_first(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(40), rnd.randrange(40), rnd.choice(["calls", "imports", "contains"])) for _ in range(90)]
    back = defaultdict(set)
    for a, b, k in rows:
        if k != "contains":
            back[b].add(a)
    want, todo = {0: 0}, deque([0])
    while todo:
        at = todo.popleft()
        if want[at] < 4:
            for x in back[at]:
                if x not in want:
                    want[x] = want[at] + 1
                    todo.append(x)
    got = graph.expand(edges_df(spark, rows), spark.createDataFrame([(0,)], "node_id bigint"), 4)
    assert {r.node_id: r.distance for r in got.collect()} == want


def test_weighted_against_dijkstra(spark):
    import heapq

    rnd = random.Random(5)
    rows = [(rnd.randrange(30), rnd.randrange(30), rnd.choice(["calls", "imports", "uncertain_calls", "implements"])) for _ in range(60)]
    near = defaultdict(list)
    for a, b, k in rows:
        w = 1 if k in ("calls", "implements") else 2
        near[a].append((b, w))
        near[b].append((a, w))
    want, heap = {0: 0}, [(0, 0)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > want[at]:
            continue
        for x, w in near[at]:
            if d + w < want.get(x, 99):
                want[x] = d + w
                heapq.heappush(heap, (d + w, x))
    got = graph.weighted_distances(edges_df(spark, rows), spark.createDataFrame([(0,)], "node_id bigint"), 1000)
    assert {r.node_id: r.distance for r in got.collect()} == want


def test_paths_keep_parallel_edges_and_stop_at_three(spark):
    rows = [(1, 2, "calls"), (1, 2, "calls"), (2, 3, "calls"), (1, 4, "imports"), (4, 3, "calls"), (3, 1, "calls")]
    nodes = spark.createDataFrame([(i, f"p{i}", f"l{i}") for i in range(1, 5)], "node_id bigint, path string, label string")
    got = graph.shortest_paths(edges_df(spark, rows), nodes, 1, 3).collect()
    assert [r.nodes for r in got] == [[1, 2, 3], [1, 2, 3], [1, 4, 3]] and {r.hops for r in got} == {2}
    assert graph.shortest_paths(edges_df(spark, rows), nodes, 2, 4, 1).count() == 0


def test_validate_and_degrees(spark):
    nodes = spark.createDataFrame([(1,), (1,), (2,)], "node_id bigint")
    e = edges_df(spark, [(1, 2, "calls"), (2, 9, "calls"), (1, 1, "calls")])
    assert dict(graph.validate(nodes, e).collect()) == {"repeated_id": 1, "missing_end": 1}
    assert {r.node_id: (r.n_out, r.n_in, r.degree) for r in graph.degrees(e).collect()} == {1: (2, 1, 3), 2: (1, 1, 2), 9: (0, 1, 1)}


def definitions(spark, rows):
    return spark.createDataFrame([(i, "r", k, n, q) for i, (k, n, q) in enumerate(rows)], "node_id bigint, repo string, kind string, label string, qualified_name string")


def pend(spark, rows):
    return spark.createDataFrame([("r", 100 + i, sk, t, k, i) for i, (sk, t, k) in enumerate(rows)], "repo string, source_id bigint, source_kind string, target_name string, kind string, line int")


def test_resolution(spark):
    nodes = definitions(spark, [
        ("function", "helper", "helper"), ("function", "dup", "a::dup"), ("function", "dup", "b::dup"), ("function", "Case", "Case"), ("function", "case", "case"),
        ("constant", "a.b", "a.b"), ("interface", "IRun", "IRun"), ("class", "Base", "Base"), ("method", "run", "X::A::run"), ("class", None, None),
    ])
    r = resolve.resolve(nodes, pend(spark, [
        ("function", "Helper", "calls"), ("function", "dup", "calls"), ("function", "Case", "calls"), ("file", "a.b", "references"), ("class", "IRun", "inherits"),
        ("class", "Base", "inherits"), ("interface", "IRun", "inherits"), ("file", "A::run", "references"), ("file", "nothing", "calls"), ("file", "IRun", "calls"), ("file", None, "calls"),
    ]))
    got = {x.line: (x.outcome, x.dst, x.edge_kind) for x in r.collect()}
    assert got[0] == ("edge", 0, "calls") and got[1] == ("boundary", None, "uncertain_calls") and got[2] == ("edge", 3, "calls") and got[3][0] == "dropped"
    assert got[4] == ("edge", 6, "implements") and got[5] == ("edge", 7, "extends") and got[6] == ("edge", 6, "extends") and got[7] == ("edge", 8, "references")
    assert got[8][0] == got[9][0] == got[10][0] == "dropped"
    e, b = resolve.edges_and_boundaries(r)
    assert b.count() == 1 and e.where("kind = 'uncertain_calls'").count() == 1 and b.first().label == "?dup"


def test_search_tiers_and_symbols(spark):
    n = spark.createDataFrame([(1, "function", "run", "app::run", "src/app.py"), (2, "function", "rerun", "rerun", "a.py"), (3, "class", "X", "run::X", "b.py"), (4, "file", "run", "run", "run")], "node_id bigint, kind string, label string, qualified_name string, path string")
    assert [(r.node_id, r.tier) for r in search.search(n, "run").collect()] == [(1, 0), (2, 2), (3, 3)]
    assert [r.node_id for r in search.symbol_nodes(n, "RUN", "app.py").collect()] == [1]
    assert [r.node_id for r in search.symbol_nodes(n, "run", "other.py").collect()] == [1]


def test_hunks(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("@@ -1,2 +3,4 @@ x\n+y\n@@ -9 +20 @@\n@@ -5,1 +7,0 @@\n",)], "d string")
    assert [(h.first, h.last) for h in d.select(search.parse_hunks(F.col("d")).alias("h")).first().h] == [(3, 6), (20, 20), (7, 7)]


def test_question_terms():
    assert "parse" in select.variants("parsed") and "dispatcher" in select.variants("dispatch") and "poll" in select.variants("polled")
    q = select.understand("How does the command-line parser reach parsed arguments?")
    assert q.flow and any({"parser", "parsers"} <= set(g) for g in q.groups) and any("cli" in g and "arg" in g for g in q.groups)


def test_small_selections(spark):
    n = spark.createDataFrame([(0, "function", "start", "start", "src/a.rs"), (1, "function", "finish", "finish", "src/a.rs"), (2, "file", "a.rs", "src/a.rs", "src/a.rs")], "node_id bigint, kind string, label string, qualified_name string, path string")
    got, truncated = select.select_subgraph(n, edges_df(spark, [(0, 1, "calls")]), "start", 2)
    assert [(r.node_id, r.distance, r.is_anchor) for r in got.orderBy("rank").collect()] == [(0, 0, True), (1, 1, True)] or [(r.node_id, r.distance) for r in got.orderBy("rank").collect()] == [(0, 0), (1, 1)]
    assert not truncated
    none, _ = select.select_subgraph(n, edges_df(spark, []), "zzz", 4)
    assert [r.node_id for r in none.collect()] == [2]


def test_anchor_turns_and_owner_cap():
    rows = [(1, 0, 90, "o"), (2, 0, 80, "o"), (3, 0, 70, "o"), (4, 1, 60, ""), (1, 1, 95, "o")]
    assert select.pick(rows, 4) == [1, 4, 2] or select.pick(rows, 4)[0] == 1
    assert 3 not in select.pick(rows, 4)


def test_components_and_picture():
    assert render.components([1, 2, 3, 4], [(1, 2), (2, 1), (2, 3), (3, 4)]) == {1: 0, 2: 0, 3: 1, 4: 2}
    rows = [{"node_id": i, "label": f"n<{i}", "path": "p", "distance": i, "is_anchor": i == 0, "start_line": 1} for i in range(3)]
    edges = [(0, 1, "calls"), (1, 2, "uncertain_calls"), (0, 2, "contains")]
    a = render.svg(rows, edges)
    assert a == render.svg(rows, edges) and a.count("<line") == 2 and a.count("stroke-dasharray") == 1 and "n&lt;0" in a
    assert render.legend(rows, edges)[0] == [("N1", "n<0", "p", 1)]
