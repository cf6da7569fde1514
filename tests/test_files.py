import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from topolane.operators.lifecycle import find_key
from topolane.sources import git, ledger_file
from topolane.sources.lock import Lock


def test_changed_ranges(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("1\n2\n3\n4\n")
    (tmp_path / "gone.py").write_text("x\n")
    run("add", "-A")
    run("commit", "-qm", "c")
    (tmp_path / "a.py").write_text("1\ntwo\n3\n4\n5\n")
    (tmp_path / "gone.py").unlink()
    (tmp_path / "new.py").write_text("n\n")
    got = sorted((r.path, r.first, r.last, r.deleted) for r in git.changed_ranges(spark, str(tmp_path)).collect() if r.first is not None)
    assert got == [("a.py", 2, 2, False), ("a.py", 5, 5, False)]
    rest = sorted((r.path, r.deleted) for r in git.changed_ranges(spark, str(tmp_path)).collect() if r.first is None)
    assert rest == [("gone.py", True), ("new.py", False)]
    with pytest.raises(ValueError, match="outside"):
        git.changed_ranges(spark, str(tmp_path), paths=["../x"])


def test_ledger_file(spark, tmp_path):
    path = str(tmp_path / "l.jsonl")
    e = lambda kind, c=None: {"type": kind, "harness": "h", "session_id": "s", "correlation_id": c}
    assert ledger_file.append(path, [e("repository_synced", "a"), e("map_rendered", "b")]) == 2
    assert ledger_file.append(path, [e("repository_synced", "a")]) == 2
    with pytest.raises(ValueError, match="not possible"):
        ledger_file.append(path, [e("edit_applied")])
    with open(path, "a") as f:
        f.write('{"version": 1, "seq')
    assert ledger_file.read(spark, path).count() == 2
    with open(path, "a") as f:
        f.write("broken\n")
    with pytest.raises(Exception, match="corrupt ledger line"):
        ledger_file.read(spark, path).collect()


def test_concurrent_writers(tmp_path):
    path = str(tmp_path / "l.jsonl")
    ts = [threading.Thread(target=ledger_file.append, args=(path, [{"type": "repository_synced", "correlation_id": str(i)}])) for i in range(16)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    import json

    assert [json.loads(x)["sequence"] for x in open(path)] == list(range(1, 17))


def test_lock_is_exclusive_and_stale_ones_fall(tmp_path):
    with Lock(tmp_path / "x"):
        with pytest.raises(TimeoutError):
            Lock(tmp_path / "x", wait=0.2).__enter__()
    (tmp_path / "x").write_text("dead")
    with Lock(tmp_path / "x", wait=2, stale=-1):
        assert (tmp_path / "x").exists()
    assert not (tmp_path / "x").exists()


def test_find_key(spark):
    d = spark.createDataFrame([('{"a": [{"exit_code": 3}], "b": {"ok": true}}',), ("no",), (None,)], "raw string")
    assert [tuple(r) for r in d.select(find_key(F.col("raw"), ["exit_code", "exitCode"]).alias("c"), find_key(F.col("raw"), ["ok"]).alias("o")).collect()] == [("3", "true"), (None, None), (None, None)]


def test_source_windows_of_all_symbols(spark):
    import __spark_entry__
    from topolane.plans.code import code_nodes

    sf = "/root/testdata/sf0.001"
    got = {r.node_id: r.source for r in __spark_entry__.queries()["source_windows"](spark, sf).collect()}
    rows = code_nodes(spark, sf).where("kind <> 'file'").join(spark.read.parquet(f"{sf}/source_files.parquet").where("content is not null").select("file_id", "content"), "file_id").collect()
    assert set(got) == {r.node_id for r in rows} and {"function", "class"} <= {r.kind for r in rows}
    for r in rows:
        lines, lo = r.content.replace("\r\n", "\n").split("\n"), max(r.start_line - 2, 1)
        whole = "\n".join(f"{i} | {x}" for i, x in list(enumerate(lines, 1))[lo - 1 : r.end_line + 2][:220])[:7000]
        assert got[r.node_id] == (whole if not r.path.lower().endswith((".yml", ".yaml", ".properties")) else "[configuration values are withheld]")
    assert max(s.count("\n") for s in got.values()) >= 12
