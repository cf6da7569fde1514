import pytest

from topolane.project import Project

FILES = {
    "app.py": "from helper import helper\ndef run():\n    return helper()\n",
    "helper.py": "from leaf import leaf\ndef helper():\n    return leaf()\n",
    "leaf.py": "def leaf():\n    return 1\n",
    "tests/test_app.py": "from app import run\ndef test_run():\n    run()\n",
    "application.properties": "service.password=hidden-value\nservice.name=x\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "tests").mkdir()
    for name, text in FILES.items():
        (root / name).write_text(text)
    store = tmp_path_factory.mktemp("store")
    p = Project.index(spark, str(root), str(store / "i"))
    p.root, p.store = root, store / "i"
    return p


def labels(df):
    return {r.label for r in df.collect()}


def test_navigation(spark, project):
    assert ("app.py", 2) in {(r.path, r.start_line) for r in project.search("run", "function").collect()}
    assert labels(project.callers("helper")) == {"run"} and labels(project.callees("run")) == {"helper"}
    assert {"run", "test_run"} <= labels(project.impact("helper", depth=3))
    assert project.path("run", "leaf", mode="execution") == ([(["run", "helper", "leaf"], ["calls", "calls"])], False)
    assert project.path("leaf", "run", mode="execution") == ([], True)
    with pytest.raises(LookupError):
        project.path("nothing", "run")
    with pytest.raises(ValueError):
        project.search("  ")


def test_files_and_views(spark, project):
    assert [(r.path, r.symbols > 0) for r in project.list_files(pattern="**/test_*.py").collect()] == [("tests/test_app.py", True)]
    assert {r.path for r in project.list_files(depth=1).collect()} == {"app.py", "helper.py", "leaf.py", "application.properties"}
    symbols, dependents = project.file_view("helper.py")
    assert "helper" in labels(symbols) and {r.dependent for r in dependents.collect()} == {"app.py"}
    shown = project.node("service.password", code=True).first()
    assert "withheld" in shown.source and "hidden-value" not in shown.source
    assert "2 | def run" in project.node("run", code=True).first().source
    status = {(r.what, r.name): r.n for r in project.status().collect()}
    assert status[("language", "python")] == 4 and status[("version", "index")] == 4


def test_changes(spark, project):
    ranges = spark.createDataFrame([(str(project.root), "helper.py", 2, 2)], "repo string, path string, first int, last int")
    direct, affected, tests = project.changes(ranges, 3)
    assert "helper" in labels(direct) and "run" in labels(affected) and [r.label for r in tests.collect()][0] == "test_run"


def test_context_budget_and_delta(project):
    from tests.test_sessions import python_estimate

    q = "How does run reach leaf?"
    for budget in (128, 600, 2000):
        assert python_estimate(project.context(q, budget)["text"]) <= budget
    first = project.context(q, 256, session="s")
    assert "A1" in first["kept"]
    assert "unchanged" in project.context(q, 256, session="s")["text"]
    assert "A1" in project.context(q, 256, session="s", full=True)["kept"]
    assert len(project.brief(q, 128)) <= 512
    m = project.map(q)
    assert m["svg"] == project.map(q)["svg"] and m["anchors"]
    files, inner = project.explore("run helper")
    assert "app.py" in {r.path for r in files.collect()} and "calls" in {r.kind for r in inner.collect()}


def test_incremental(spark, project):
    (project.root / "leaf.py").write_text("def leaf2():\n    return 1\n")
    (project.root / "helper.py").unlink()
    again = Project.index(spark, str(project.root), str(project.store))
    got = labels(again.nodes)
    assert "leaf2" in got and "leaf" not in got - {"leaf"} | set() and "helper.py" not in {r.path for r in again.nodes.collect()}
    assert Project.open(spark, str(project.store)).nodes.count() == again.nodes.count()
    assert Project.open(spark, str(project.store) + "x") is None


def test_change_records_anchors_and_trail(spark, project):
    ranges = spark.createDataFrame([(str(project.root), "helper.py", 2, 2)], "repo string, path string, first int, last int")
    rows = project.evidence("what changed in helper", ranges=ranges).collect()
    changes = [r.text for r in rows if r.priority == 850]
    assert any(t.startswith("change direct helper function helper.py") for t in changes) and any(t.startswith("change test") and "test_run" in t for t in changes)
    assert any(t.startswith("change affected") and " run " in t for t in changes)
    chosen, _, _ = project.selection("what changed in helper", 48)
    assert sum(r.priority == 900 for r in rows) == min(12, sum(r["kind"] != "file" for r in chosen)) > sum(r["is_anchor"] and r["kind"] != "file" for r in chosen)
    r = project.node("helper", "helper.py").where("kind = 'function'").first()
    assert [x.split(" ")[0] for x in r.calls] == ["leaf"] and "run (app.py:2)" in r.callers
