"""File ids beyond 32 bits: each query gives what it gives where those files have the next free numbers, and what the SQL gives there."""

from collections import Counter

import pytest

import __spark_entry__
from topolane.plans.code import call_sites, code_nodes, file_numbers

NAMES = [
    "changes_overlap", "source_windows", "source_window", "resolve_outcomes", "select_expand",
    "resolve_unique", "graph_nodes_by_kind", "hunk_parse", "map_svg", "file_dependents",
    "resolve_ambiguous_boundary", "graph_edges_by_kind", "search_tiers", "search_kind_filter", "node_by_symbol",
    "files_glob", "resolve_suffix", "select_term_scores", "select_scores",
]
KINDS = ("file", "class", "method", "function", "function")


def rows(base, n=4):
    """Files of two repositories whose functions call each other, and their symbols."""
    files, nodes = [], []
    for i in range(n):
        path, other = f"src/ledger{i}.py", (i + 1) % n
        labels = (path, f"Ledger{i}", f"step{i}", "group_lane" if i == 0 else f"only{i}", "shared")
        text = f"class Ledger{i}:\n  def step{i}(self):\n    only{other}(1)\n    shared()\ndef {labels[3]}():\n  step{other}()\n  Ledger{other}()\ndef shared():\n  pass\n"
        files.append((base + i, f"r{i % 2 * (base > 9) + base % 7}", path, text, 9))
        for k, (label, (lo, hi)) in enumerate(zip(labels, ((1, 9), (1, 4), (2, 4), (5, 7), (8, 9)))):
            nodes.append((base + i, path, k, KINDS[k], label, f"Ledger{i}::{label}" if k == 2 else label, lo, hi, None if k == 0 else 1 if k == 2 else 0))
    return files, nodes


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """(wide, narrow): the same rows; in `narrow` the ids that do not fit have the numbers after the greatest that fits."""
    parts = [rows(b) for b in (1, 1_500_000_000, 3_000_000_000, 1 << 62)]
    out, most = [], 1_500_000_003
    wide = sorted(f[0] for fs, _ in parts for f in fs if f[0] >= 1 << 31)
    for name, no in (("wide", {}), ("narrow", {x: most + 1 + i for i, x in enumerate(wide)})):
        at = tmp_path_factory.mktemp(name)
        files = [(no.get(f[0], f[0]), *f[1:]) for fs, _ in parts for f in fs]
        nodes = [(no.get(n[0], n[0]), *n[1:]) for _, ns in parts for n in ns]
        spark.createDataFrame(files, "file_id bigint, repo string, path string, content string, n_lines int").write.parquet(f"{at}/source_files.parquet")
        spark.createDataFrame(nodes, "file_id bigint, path string, local_id int, kind string, label string, qualified_name string, start_line int, end_line int, parent_local_id int").write.parquet(f"{at}/file_nodes.parquet")
        out.append(str(at))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_on_wide_file_ids(spark, folders, name):
    import duckdb

    wide, narrow = folders
    got = Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, wide).collect())
    assert got and got == Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, narrow).collect())
    if name in (twins := __spark_entry__.oracle_sql()):
        c = duckdb.connect()
        for t in ("source_files", "file_nodes"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{narrow}/{t}.parquet/*.parquet'")
        assert got == Counter(c.execute(twins[name]).fetchall())


def test_file_numbers(spark):
    def numbers(*ids):
        d = spark.createDataFrame([(i, "r") for i in ids], "file_id bigint, repo string")
        return {r.file_id: r.file_no for r in file_numbers(d).collect()}

    top = (1 << 31) - 1
    assert numbers(1, -4, top) == {1: 1, -4: -4, top: top}
    assert numbers(7, 1 << 40, 1 << 31, 1 << 31) == {7: 7, 1 << 31: 8, 1 << 40: 9}
    assert numbers(top, 1 << 31, 1 << 62) == {top: top, 1 << 31: -(1 << 31), 1 << 62: 1 - (1 << 31)}
    assert numbers(-(1 << 40), 1 << 40) == {-(1 << 40): 0, 1 << 40: 1}
    with pytest.raises(ValueError, match="more files"):
        numbers(-(1 << 31), top, 1 << 31)


def test_nothing_is_broadcast_by_the_size_of_its_file(spark, folders):
    """Texts and the lines unnested from them are no broadcast sides, however small their file is."""
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    n = code_nodes(spark, folders[1])
    for d, keys in ((__spark_entry__.queries()["source_windows"](spark, folders[1]), "file_id"), (__spark_entry__.queries()["source_window"](spark, folders[1]), "file_id"), (call_sites(spark, folders[1], n), "line")):
        top = next(x for x in plan(d).splitlines() if "Join" in x)
        assert "SortMergeJoin" in top and keys in top
