"""Queries on calls: rows move by file and by name, never by line, and odd files give what the SQL gives."""

import re
from collections import Counter

import pytest

import __spark_entry__
from topolane.plans import selection
from topolane.session import cut

NAMES = ["resolve_outcomes", "graph_edges_by_kind", "resolve_unique", "resolve_ambiguous_boundary", "file_dependents", "select_scores", "select_expand", "map_svg"]
CALLS = ["resolve_outcomes", "resolve_unique", "resolve_ambiguous_boundary", "graph_edges_by_kind", "file_dependents"]
FILES = "file_id bigint, repo string, path string, content string, n_lines int"
NODES = "file_id bigint, path string, local_id int, kind string, label string, qualified_name string, start_line int, end_line int, parent_local_id int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    text = "def outer():\r\n  run() ; run() ; Run()\r\n  def inner():\r\n    inner() ; other(x(1))\r\n  RUN()\r\n\r\nrun()"
    files = [(1, "a", "src/a.py", text, 7), (2, "a", "src/b.py", "def run(): outer()\ndef Run(): other()\ndef other(): outer()", 3), (3, "b", "src/a.py", text, 7), (3, "b", "src/a.py", text, 7), (4, "b", "e.py", "", 1), (5, "b", "n.py", None, 0), (6, None, "m.py", "f()", 1)]
    nodes = [(f, "src/a.py", k, *n) for f in (1, 3) for k, n in enumerate((("file", "src/a.py", None, 1, 7, None), ("function", "outer", "m::outer", 1, 5, 0), ("method", "inner", "m::outer::inner", 3, 4, 1), ("function", "run", "m::run", 6, 99, 0), ("function", "late", None, 8, 9, 0), ("function", "zero", None, 0, 3, 0), ("function", None, None, 2, 2, 0)))]
    nodes += [(2, "./src/b.py", k, kind, label, f"b::{label}", k + 1, k + 1, None) for k, (kind, label) in enumerate((("function", "run"), ("class", "Run"), ("method", "other")))]
    nodes += [(4, "e.py", 1, "function", "OTHER", None, 1, 1, None), (5, "n.py", 1, "function", "x", None, 1, 1, None), (6, "m.py", 1, "function", "f", None, 1, 1, None), (9, "gone.py", 1, "function", "x", None, 1, 1, None)]
    spark.createDataFrame(files, FILES).write.parquet(f"{at}/source_files.parquet")
    spark.createDataFrame(nodes + nodes[:4], NODES).repartition(3).write.parquet(f"{at}/file_nodes.parquet")
    return str(at)


@pytest.mark.parametrize("name", CALLS)
def test_odd_files(spark, odd, name):
    import duckdb

    c = duckdb.connect()
    for t in ("source_files", "file_nodes"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    want = Counter(c.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert want and want == Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, odd).collect())


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_moved_by_line(spark, odd, name, monkeypatch):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    seen = []
    monkeypatch.setattr(selection, "cut", lambda d: seen.append(plan(d)) or cut(d))
    seen.append(plan(__spark_entry__.queries()[name](spark, odd)))
    of_sites = [x for x in seen if "regexp_extract_all" in x]
    assert of_sites and not any(re.search(r"Exchange hashpartitioning\([^)]*\bline#", x) or "split(translate(qualified_name" in x for x in of_sites)


def test_file_dependents_moves_no_boundaries(spark, odd):
    plan = __spark_entry__.queries()["file_dependents"](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan and "uncertain_" not in plan


@pytest.mark.parametrize("name", ["select_term_scores", "select_scores"])
def test_words_are_not_worked_out_again_by_a_filter(spark, odd, name):
    plan = __spark_entry__.queries()[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert not any("[^\\p{L}\\p{N}]+" in x for x in plan.splitlines() if re.match(r"[\s:+*()\d-]*Filter ", x))
