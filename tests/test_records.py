import json
import random
from datetime import datetime

from topolane.operators import dedup, drift


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "delivery_id bigint, received_at timestamp, source struct<harness:string,session_id:string,event_id:string>, note string")


def dropped(df):
    return sorted(r.delivery_id for r in dedup.mark_copies(df, dedup.message_key(), "received_at", ["delivery_id"]).where("is_copy").collect())


def test_copies(spark):
    t = lambda m: datetime(2026, 1, 1, 0, m)
    rows = [
        (1, t(5), ("Codex", "s", "e"), "a"), (2, t(3), ("codex ", " s", "e\t"), "b"), (3, t(3), ("CODEX", "s", "e"), None), (4, t(1), ("claude", "s", "e"), "a"),
        (5, t(1), ("codex", None, "e"), "a"), (6, t(2), ("codex", None, "e"), "a"), (7, t(1), ("codex", "s", " "), "a"), (8, t(2), ("codex", "s", " "), "a"), (9, t(2), None, "a"),
        (10, None, ("x", "y", "z"), "a"), (11, t(9), ("x", "y", "z"), "a"), (12, t(1), (None, "y", "z"), "a"), (13, t(2), (None, "y", "z"), "a"), (14, t(1), ("codex", "s", "E"), "case"),
    ]
    assert dropped(deliveries(spark, rows)) == [1, 3, 10, 13]
    assert dropped(deliveries(spark, [])) == []


def test_copies_of_a_hot_message_and_repeated_rows(spark):
    rnd = random.Random(2)
    rows = [(i, datetime(2026, 1, 1, 0, rnd.randrange(50)), ("h", "s", "hot" if i % 3 else f"e{i % 40}"), None) for i in range(600)]
    rows += rows[:20]  # the same rows again, ids included
    df = deliveries(spark, rows)
    kept = dedup.keep_first(df, dedup.message_key(), "received_at", ["delivery_id"]).collect()
    best = {}
    for i, at, s, _ in rows:
        best[s] = min(best.get(s, (at, i)), (at, i))
    assert sorted((r.received_at, r.delivery_id) for r in kept) == sorted(best.values())


def test_batches_against_a_store(spark):
    t = datetime(2026, 1, 1)
    one = dedup.absorb_batch(deliveries(spark, [(1, t, ("a", "s", "e"), None), (2, t, ("a", "s", "e"), None)]), spark.createDataFrame([], "k0 string, k1 string, k2 string"), dedup.message_key(), "received_at", ["delivery_id"])
    assert [r.delivery_id for r in one.collect()] == [1]
    two = dedup.absorb_batch(deliveries(spark, [(3, t, ("A", "s", "e"), None), (4, t, ("a", "s", "f"), None), (5, t, ("a", None, "f"), None)]), one.select("k0", "k1", "k2"), dedup.message_key(), "received_at", ["delivery_id"])
    assert sorted(r.delivery_id for r in two.collect()) == [4, 5]


def hooks(spark, files):
    rows, n = [], 0
    for feed, file_no, lines in files:
        for i, x in enumerate(lines):
            n += 1
            rows.append((n, feed, "h", file_no, i, x if isinstance(x, str) or x is None else json.dumps(x), "extra"))
    return spark.createDataFrame(rows, "record_id bigint, feed_id bigint, harness string, file_no int, line_no int, raw string, footer string")


def found(df):
    return sorted(tuple(r) for r in drift.changes(df).collect())


def test_drift(spark):
    df = hooks(spark, [
        (1, 2, [{"session_id": "a", "a": {"x": 1}, "gone": 1, "out": "t", "n": None}, '{"cut": ']),
        (1, 5, [{"sessionId": "b", "a": {"x": 1.5, "y": [1]}, "out": {"text": "t", "bytes": 3}, "back": 1}, None, "[1]", '"s"']),
        (1, 6, [{"sessionId": "c", "a": {"x": "1"}, "out": "t", "n": 1, "e": {}}]),
        (1, 9, [{"sessionId": "c", "back": 2, "out": {"text": "t"}}]),
        (2, 1, [{"z": 1}]), (2, 4, ["broken"]),
    ])
    assert found(df) == sorted([
        (1, 5, "renamed", "session_id", "sessionId"), (1, 5, "removed", "gone", ""), (1, 5, "added", "a.y", ""), (1, 5, "retyped", "out", ""), (1, 5, "added", "back", ""),
        (1, 6, "removed", "a.y", ""), (1, 6, "retyped", "a.x", ""), (1, 6, "added", "n", ""), (1, 9, "removed", "a.x", ""), (1, 9, "removed", "n", ""), (2, 4, "removed", "z", ""),
    ])
    assert found(hooks(spark, [])) == []


def test_schema_text():
    text = "OBJECT<a b: STRING, `c.d`: ARRAY<OBJECT<x: BIGINT>>, e: OBJECT<f: DECIMAL(3,1), g: VOID>, h: BOOLEAN>"
    assert drift.parse_schema(text.replace("a b", "`a b`")) == [("a b", "string"), ("c.d", "array"), ("e", "object"), ("e.f", "number"), ("e.g", "null"), ("h", "boolean")]


def test_unified(spark):
    df = hooks(spark, [(1, 1, [{"conversation_id": "s", "tool_response": {"output": {"text": "x", "bytes": 1}, "exit_code": "7"}}, {"sessionId": 5, "exitCode": 1.0, "succeeded": True}, "cut {", None])])
    got = [(r.readable, r.u_session_id, r.u_output, r.u_exit_code, r.u_success, r.rest) for r in drift.unified(df).orderBy("line_no").collect()]
    assert got == [(True, "s", "x", 7, None, {"tool_response.output.bytes": "1"}), (True, "5", None, 1, True, {}), (False, None, None, None, None, {}), (False, None, None, None, None, {})]


def test_unified_holds_every_value(spark):
    lines = [
        {"new": {"deep": [1, {"a": None}], "k.k": "q", "e": {}, "n": None}, "status": "a", "outcome": "b"}, '{"exit_code": 12345678901234567890123, "big": 12345678901234567890123.50, "x": 1.0e5}',
        {"exit_code": "many", "success": 2, "error": "TRUE"}, '{"a": 1, "a": 2}', '{"a": NaN}', "[1]", "", {"a": {"b": 1}, "a.b": 2}, {"exit_code": 9007199254740993},
    ]
    got = drift.unified(hooks(spark, [(1, 1, lines)])).orderBy("line_no").collect()
    assert got[0].u_status == "a" and got[0].rest == {"new.deep": '[1,{"a":null}]', "new.k.k": '"q"', "new.e": "{}", "outcome": '"b"'}
    assert got[1].rest == {"exit_code": "12345678901234567890123", "big": "12345678901234567890123.50", "x": "1.0e5"}
    assert got[2].rest == {"exit_code": '"many"', "success": "2", "error": '"TRUE"'}
    assert [r.readable for r in got] == [True, True, True, False, False, False, False, True, True]
    assert got[7].rest == {"a.b": "1", "a.b'": "2"} and got[8].u_exit_code == 9007199254740993
    # A line that holds the same path twice counts once in its footer, so it is left out here.
    counts = drift.values(hooks(spark, [(1, 1, lines[:1] + lines[2:7]), (1, 2, ["cut {"]), (None, None, [{"a": 1}])])).collect()
    assert counts and all(r.n_in == r.n_out for r in counts)


def test_islands(spark):
    df = hooks(spark, [(1, 2, [{"a": 1, "b": 1}]), (1, 5, [{"a": "x"}]), (1, 6, [{"a": 1, "b": 2}, {"b": 3}]), (1, 9, [{"a": 1}])])
    got = sorted((r.field, r.type, r.island, r.from_file, r.to_file, r.n_files, r.n_lines, r.first_file, r.next_file) for r in drift.islands(df).collect())
    assert got == [
        ("a", "number", 1, 2, 2, 1, 1, 2, 5), ("a", "number", 2, 6, 9, 2, 2, 2, None), ("a", "string", 1, 5, 5, 1, 1, 2, 6), ("b", "number", 1, 2, 2, 1, 1, 2, 5), ("b", "number", 2, 6, 6, 1, 2, 2, 9),
    ]
    assert drift.islands(hooks(spark, [])).count() == 0


def test_alias_learned_from_many_feeds(spark):
    feeds = [(f, n, [{"qqq": 1, "keep": 1} if n == 1 else {"zzz": 1, "keep": 1}]) for f in range(6) for n in (1, 2)]
    feeds += [(10, 1, [{"keep": 1, "www": 1}]), (10, 2, [{"keep": 1, "vvv": 1}])]
    got = found(hooks(spark, feeds))
    assert [g for g in got if g[0] < 6] == [(f, 2, "renamed", "qqq", "zzz") for f in range(6)]
    assert [g for g in got if g[0] == 10] == [(10, 2, "added", "vvv", ""), (10, 2, "removed", "www", "")]
