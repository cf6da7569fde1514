import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from topolane.operators import graph, hooks, index, ledger
from topolane.project import Project
from topolane.schemas import STATES, TRANSITIONS
from topolane.sources import ledger_file

CODEX = [
    {"hook_event_name": "SessionStart"}, {"hook_event_name": "PermissionRequest", "tool_name": "apply_patch", "tool_input": {"command": "*** Update File: a.rs\n"}},
    {"hook_event_name": "PostToolUse", "tool_name": "apply_patch", "tool_use_id": "e1", "tool_input": {"command": "*** Update File: a.rs\n"}, "tool_response": {"output": "Done"}},
    {"hook_event_name": "PostToolUse", "tool_name": "apply_patch", "tool_use_id": "e1", "tool_input": {"command": "*** Update File: a.rs\n"}, "tool_response": {"output": "Done"}},
    {"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_use_id": "c1", "tool_input": {"command": "cargo test"}, "tool_response": {"exit_code": 101}},
    {"hook_event_name": "PermissionRequest", "tool_name": "apply_patch", "turn_id": "2", "tool_input": {"command": "*** Update File: b.rs\n"}},
    {"hook_event_name": "PostToolUse", "tool_name": "apply_patch", "tool_use_id": "e2", "tool_input": {"command": "*** Add File: b.rs\n*** Update File: a.rs\n"}},
    {"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_use_id": "c2", "tool_input": {"command": "cargo test"}, "tool_response": {"exit_code": 0}},
    {"hook_event_name": "Stop"}, {"hook_event_name": "UserPromptSubmit"},
]


def records(spark, lines, harness="codex", session="s"):
    rows = [(harness, i // 4, i, i, x if isinstance(x, str) or x is None else json.dumps({"session_id": session, "turn_id": "1", **x})) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "harness string, file_no int, line_no int, record_id bigint, raw string")


def told(df):
    return [(r.ledger_event, r.state_before, r.state_after) for r in df.orderBy("file_no", "line_no", "step").collect()]


def test_recorded_session_ends_complete(spark):
    events = hooks.emit(hooks.acts(records(spark, CODEX)))
    assert told(events) == [
        ("authorization_requested", "idle", "awaiting_authorization"), ("edit_authorized", "awaiting_authorization", "editing"), ("edit_applied", "editing", "editing"),
        ("verification_started", "editing", "verifying"), ("verification_failed", "verifying", "blocked"), ("authorization_requested", "blocked", "awaiting_authorization"),
        ("edit_authorized", "awaiting_authorization", "editing"), ("edit_applied", "editing", "editing"), ("verification_started", "editing", "verifying"), ("verification_passed", "verifying", "complete"),
    ]
    assert [r.detail for r in events.where("ledger_event = 'edit_applied'").orderBy("line_no").collect()] == ["a.rs", "a.rs,b.rs"]


def test_every_step_is_a_permitted_transition_and_equals_a_plain_fold(spark):
    rnd = random.Random(3)
    names = list(hooks.EMITS)
    rows = [("h", rnd.choice(["a", "b", None]), i // 7, i, rnd.choice(names), "d", f"k{rnd.randrange(90)}") for i in range(120)]
    done = spark.createDataFrame(rows, "harness string, session_id string, stretch int, at int, act string, detail string, correlation string")
    got = sorted((r.at, r.step, r.ledger_event, r.state_before, r.state_after) for r in hooks.emit(done, ("stretch", "at")).collect())
    state, seen, want = {}, set(), []
    for _, session, _, at, act, _, key in rows:
        if key in seen:
            continue
        seen.add(key)
        s = state.get(session, "idle")
        for step, e in enumerate(hooks.EMITS[act].get(s, ((), s))[0]):
            after = TRANSITIONS[e][STATES.index(s)]
            want.append((at, step, e, s, after))
            s = after
        state[session] = s
    assert got == want and all(w[4] is not None for w in want)


def test_odd_records(spark):
    odd = ["{cut", None, "[1]", {}, {"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_input": {"command": "ls"}}, {"hook_event_name": "Other"}]
    assert hooks.emit(hooks.acts(records(spark, odd))).count() == 0 and hooks.emit(hooks.acts(records(spark, []))).count() == 0
    assert told(hooks.emit(hooks.acts(records(spark, [{"hook_event_name": "stop"}, {"hook_event_name": "afterFileEdit", "file_path": "x"}], "cursor")))) == [("completed", "idle", "complete"), ("edit_observed", "complete", "editing")]


def test_responses(spark):
    t, rows, want, seen, state, n = datetime(2026, 1, 1), [], [], set(), {}, 0
    rnd = random.Random(5)
    kinds = [
        {"type": "edit_observed", "paths": ["a"]}, {"type": "verification_observed", "command": "c", "success": True}, {"type": "verification_observed", "command": "c", "success": False}, {"type": "authorization_requested", "action": "x"},
        {"type": "authorization_result", "action": "x", "allowed": True}, {"type": "authorization_result", "action": "x", "allowed": False}, {"type": "turn_finished", "outcome": "completed"}, {"type": "blocked", "reason": "r"}, {"type": "context_requested"}, {"type": "nope"},
    ]
    acts = ["edit", "passed", "failed", "request", "allow", "blocked", "completed", "blocked", "none", None]
    for i in range(80):
        k, lane = rnd.randrange(len(kinds)), rnd.choice("ab")
        key = f"e{rnd.randrange(50)}"
        rows.append((i, t + timedelta(minutes=17 * i), 1, ("h", lane, key), "/p", json.dumps(kinds[k])))
        if acts[k] is None:
            want.append((i, False, False, None, None))
            continue
        s = state.get(lane, "idle")
        again = acts[k] != "none" and (lane, key) in seen
        if acts[k] != "none" and not again:
            seen.add((lane, key))
            events, s = hooks.RESPONDS[acts[k]].get(s, ((), s))
            n += len(events)
            state[lane] = s
        want.append((i, True, again, n, s))
    df = spark.createDataFrame(rows, "delivery_id bigint, received_at timestamp, format_version int, source struct<harness:string,session_id:string,event_id:string>, cwd string, event string")
    assert sorted(map(tuple, hooks.respond(df).collect())) == want
    assert hooks.respond(df.limit(0)).count() == 0


def test_projection_lines_and_redaction(spark):
    rows = [
        (1, "s", "repository_synced", {"files": 3, "changed": 1, "removed": 0}), (2, "s", "map_rendered", {"map_id": "m", "nodes": 4, "truncated": True, "anchors": [{"visual_id": f"A{i}", "path": "p.py", "start_line": i} for i in range(5)]}),
        (3, "s", "edit_applied", {"paths": ["a", "TOKEN=x"]}), (4, "t", "verification_failed", {"command": "cargo test", "exit_code": 101, "output_bytes": 7}), (5, "t", "blocked", {"reason": "API_KEY=abc\nrest"}),
    ]
    e = spark.createDataFrame([(i, "p", s, k, json.dumps(x)) for i, s, k, x in rows], "seq int, project string, session string, event string, raw string").withColumn("payload", F.from_json("raw", ledger.PAYLOAD))
    states = spark.createDataFrame([("p", "s", "awaiting_authorization"), ("p", "t", "blocked"), ("q", "u", "idle")], "project string, session string, state string")
    got = {r.session: r for r in ledger.session_projection(e, ["project"], ["session"], ["seq"], states).collect()}
    facts = "map m nodes=4 truncated=true\nA0=p.py:0 A1=p.py:1 A2=p.py:2\nedit a,[REDACTED]\ncheck cargo test success=false exit=Some(101) bytes=7\nblocked [REDACTED]\nrest"
    assert got["s"].text == "S5 AwaitingAuthorization\n" + facts and got["t"].text == "S5 Blocked\n" + facts and got["u"].text == "S0 Idle"
    assert got["s"].estimated_tokens == -(-len(got["s"].text) // 4)
    h, s = ledger.redact_source(F.lit("h" * 60), F.lit("PASSWORD=1"))
    assert tuple(spark.range(1).select(h, s).first()) == ("h" * 48, "[REDACTED]")
    line = spark.createDataFrame([(1, "p", "idle"), (2, "p", "editing"), (1, "q", "blocked")], "sequence int, project string, state_after string")
    assert sorted(map(tuple, ledger.global_state(line, ["project"]).collect())) == [("p", "editing", 2), ("q", "blocked", 1)]


def test_builders(spark):
    nodes = spark.createDataFrame([(0, "r", "file", "a", None, "a", 1, 9), (1, "r", "function", "f", None, "a", 2, 3)], "node_id bigint, repo string, kind string, label string, qualified_name string, path string, start_line int, end_line int")
    more = graph.add_nodes(nodes, spark.createDataFrame([("r", "function", "g", "a", 5), ("r", "function", "h", "a", 4)], "repo string, kind string, label string, path string, start_line int"))
    assert sorted((r.node_id, r.label) for r in more.collect()) == [(0, "a"), (1, "f"), (2, "h"), (3, "g")]
    edges = spark.createDataFrame([(1, 2, "calls", 2), (0, 1, "contains", 2), (1, 3, "references", None)], "src bigint, dst bigint, kind string, line int")
    numbered = index.numbered_edges(more, edges)
    assert [(r.edge_id, r.kind) for r in numbered.orderBy("edge_id").collect()] == [(0, "references"), (1, "contains"), (2, "calls")]
    assert {r.node_id: (r.outgoing, r.incoming) for r in graph.adjacency(numbered).collect()} == {0: ([1], []), 1: ([0, 2], [1]), 2: ([], [2]), 3: ([], [0])}
    assert graph.add_edges(more, edges, spark.createDataFrame([(2, 3, "calls")], "src bigint, dst bigint, kind string")).count() == 4
    with pytest.raises(Exception, match="no such node"):
        graph.add_edges(more, edges, spark.createDataFrame([(2, 99, "calls")], "src bigint, dst bigint, kind string")).collect()
    given = graph.with_attributes(more, spark.createDataFrame([(1, "k", "v"), (1, "k", "w"), (2, "x", None)], "node_id bigint, name string, value string"))
    assert {r.node_id: r.attributes for r in given.collect()} == {0: None, 1: {"k": "w"}, 2: {"x": None}, 3: None}


def test_hook_lines_and_sync(spark, tmp_path):
    path = str(tmp_path / "ledger.jsonl")
    assert ledger_file.hook(spark, path, "codex", json.dumps({"session_id": "s", "hook_event_name": "SessionStart"})) == {}
    for x in CODEX[1:5]:
        assert ledger_file.hook(spark, path, "codex", json.dumps({"session_id": "s", "turn_id": "1", **x})) is None
    assert ledger_file.read(spark, path).agg(F.max_by("state_after", "sequence")).first()[0] == "blocked"
    assert "S5 Blocked" in json.dumps(ledger_file.hook(spark, path, "codex", json.dumps({"session_id": "s", "hook_event_name": "UserPromptSubmit"})))
    # Fails open.
    assert ledger_file.hook(spark, path, "codex", "{cut") is None and ledger_file.hook(spark, path, "nobody", "{}") is None and ledger_file.hook(spark, str(tmp_path / "no" / "x"), "codex", json.dumps({"session_id": "s", **CODEX[1]})) is None
    assert ledger_file.read(spark, path).count() == 5
    root, store, log = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "sync.jsonl")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    pass\n")
    assert Project.sync(spark, str(root), store, log)[1]["changed"] == 1
    assert Project.sync(spark, str(root), store, log)[1]["changed"] == 0 and ledger_file.read(spark, log).count() == 1
    (root / "a.py").write_text("def g():\n    pass\n")
    assert Project.sync(spark, str(root), store, log)[1]["changed"] == 1 and ledger_file.read(spark, log).count() == 2
