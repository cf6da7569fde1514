import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from topolane.operators import evaluate, ledger, lifecycle, packet
from topolane.schemas import EVENTS, STATES, TRANSITIONS


def test_replay_against_a_loop(spark):
    rnd = random.Random(9)
    t0 = datetime(2026, 1, 1)
    rows = [(i, f"u{rnd.randrange(4)}", t0 + timedelta(minutes=rnd.randrange(3000)), rnd.choice([*EVENTS, "other"])) for i in range(400)]
    want = {}
    for lane in {r[1] for r in rows}:
        s, bad, n = "idle", 0, 0
        for r in sorted((r for r in rows if r[1] == lane), key=lambda r: (r[2], r[0])):
            n += 1
            to = TRANSITIONS[r[3]][STATES.index(s)] if r[3] in EVENTS else None
            s, bad = (s, bad + 1) if to is None else (to, bad)
        want[lane] = (s, n - bad, bad, n)
    df = spark.createDataFrame(rows, "id int, lane string, at timestamp, event string")
    got = ledger.replay(df, ["lane"], "at", "id", "event")
    assert {r.lane: (r.state, r.applied, r.rejected, r.n) for r in got.collect()} == want
    assert ledger.replay(df.where("id < 0"), ["lane"], "at", "id", "event").count() == 0


def test_repair_cycle(spark):
    names = ["authorization_requested", "edit_authorized", "edit_applied", "verification_started", "verification_failed", "authorization_requested"]
    df = spark.createDataFrame([(i, "x", datetime(2026, 1, 1, 0, i), n) for i, n in enumerate(names)], "id int, lane string, at timestamp, event string")
    assert ledger.replay(df, ["lane"], "at", "id", "event").first().state == "awaiting_authorization"


def test_sequence_checks(spark):
    rows = [("a", 1, 1, "idle", "observing"), ("a", 2, 1, "observing", "editing"), ("a", 4, 1, "editing", "editing"), ("b", 1, 2, "idle", "idle"), ("b", 2, 1, "editing", "idle")]
    df = spark.createDataFrame(rows, "lane string, sequence int, version int, state_before string, state_after string")
    assert sorted(map(tuple, ledger.check_sequences(df).collect())) == [("a", 4, "sequence"), ("b", 1, "version"), ("b", 2, "state")]


def test_projection_is_bounded(spark):
    e = spark.createDataFrame([("l", i, n, p) for i, (n, p) in enumerate([("map_rendered", "m"), ("edit_applied", "x" * 900), ("blocked", "TOKEN=abc"), ("edit_observed", "y" * 900)])], "lane string, id int, event string, payload string")
    p = ledger.projection(ledger.latest_facts(e, ["lane"], ["id"], "event", "payload"), ["lane"]).first()
    assert p.text.startswith("map_rendered m\nedit_observed yyy") and len(p.text) <= 580 and p.estimated_tokens <= 145 and "abc" not in p.text


def test_append_is_idempotent(spark):
    schema = "correlation_id string, recorded_at int, type string"
    old = spark.createDataFrame([("a", 1, "x")], schema)
    new = spark.createDataFrame([("a", 2, "y"), ("b", 4, "z"), ("b", 3, "w"), (None, 5, "v"), (None, 5, "v")], schema)
    assert sorted(map(str, map(tuple, ledger.append(old, new).collect()))) == ["('b', 3, 'w')", "(None, 5, 'v')", "(None, 5, 'v')"]


def python_estimate(text):
    import regex

    runs = len(regex.findall(r"[\p{Alphabetic}\p{N}_]+|[^\p{White_Space}\p{Alphabetic}\p{N}_]+", text))
    return (max(-(-len(text.encode()) // 3), runs) * 105 + 99) // 100 if text else 0


def test_packing_against_greedy(spark):
    rnd = random.Random(1)
    rows = [(q, i, rnd.randrange(3), "".join(rnd.choice("ab ,é\n") for _ in range(rnd.randrange(60)))) for q in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "q int, ord int, priority int, text string")
    got = {(r.q, r.ord) for r in packet.pack_evidence(df, ["q"], 60, ["ord"]).where("kept").collect()}
    want = set()
    for q in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            if python_estimate("\n".join([*kept, r[3]])) > 60:
                break
            kept.append(r[3])
            want.add((q, r[1]))
    assert got == want


def test_packing_of_nulls_and_offset(spark):
    df = spark.createDataFrame([(1, 5, "aa"), (2, 9, None), (3, 1, "b" * 900)], "ord int, priority int, text string")
    s = packet.packed_summary(packet.pack_evidence(df.withColumn("g", F.lit(1)), ["g"], 20, ["ord"]), ["g"]).first()
    assert (s.kept, s.omitted, s.next_offset) == (2, 1, 2)
    assert packet.pack_evidence(df.withColumn("g", F.lit(1)), ["g"], 20, ["ord"], offset=1).where("kept").count() == 1


def test_delivery_and_receipts(spark):
    e = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "session_key string, evidence_id string")
    r = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "c", 2)], "session_key string, evidence_id string, clock int")
    assert sorted(map(tuple, packet.deliver(e, r).collect())) == [("t", "a")]
    assert sorted(x.evidence_id for x in packet.trim_receipts(r, 2).collect()) == ["b", "c"]
    c = packet.encode_cursor("q", 4, "flow", 7)
    assert packet.decode_cursor(c, "q", 4, "flow") == 7
    with pytest.raises(ValueError, match="cursor_stale"):
        packet.decode_cursor(c, "other", 4, "flow")
    assert packet.shrink_window("a\nb\nc\nd", 1, python_estimate) == "a\nb"


def test_envelopes(spark):
    ok = ("codex", "s", "e")
    rows = [(1, ok, "/w", '{"type":"edit_observed","paths":["a","b"]}'), (2, ok, "/w", "{}"), (1, ok, "w", '{"type":"blocked","reason":"x"}'), (1, ("codex", " \t", "e"), "/w", '{"type":"blocked"}'), (1, ok, "/w", '{"type":"edit_observed","paths":[]}'), (1, None, "/w", '{"type":"blocked"}'), (1, ok, "/w", None), (1, ok, "/w", "no json"), (1, ok, "/w", '{"type":"authorization_result","allowed":false,"action":"rm"}'), (1, ok, "/w", '{"type":"verification_observed","command":"c","success":true}')]
    df = spark.createDataFrame(rows, "format_version int, source struct<harness:string,session_id:string,event_id:string>, cwd string, event string")
    why = [r.w for r in df.select(lifecycle.rejection().alias("w")).collect()]
    assert why == [None, "version", "cwd", "session_id", "paths", "harness", "type", "type", None, None]
    got = [(r.ledger_event, r.detail) for r in lifecycle.translate(df.where(lifecycle.rejection().isNull())).collect()]
    assert got == [("edit_observed", "a,b"), ("blocked", "authorization denied: rm"), ("verification_started", "c"), ("verification_passed", "c")]


def test_hook_parts(spark):
    d = spark.createDataFrame([("*** Update File: b.rs\n@@\n*** Add File: a.rs\n*** Update File: b.rs\n", "Cargo Test --all")], "p string, c string")
    r = d.select(lifecycle.patch_paths(F.col("p")).alias("p"), lifecycle.is_verification(F.col("c")).alias("v"), lifecycle.route(F.lit("cursor"), F.lit("stop")).alias("r")).first()
    assert r.p == ["a.rs", "b.rs"] and r.v and r.r == "stop"


def test_percentiles_and_gate(spark):
    d = spark.createDataFrame([("g", v) for v in [5, 1, 9, 7, 3]], "g string, v int")
    assert tuple(evaluate.nearest_rank(d, "g", "v", {"m": 0.5, "p": 0.75}).first()) == ("g", 5, 7, 5)
    t = spark.createDataFrame([(100, 40), (100, 50), (100, 90)], "baseline_tokens int, tokens int")
    assert evaluate.gate(t, 0.4, 0.05).first().passed and not evaluate.gate(t, 0.6, 0.05).first().passed
    a, b = d.where("v < 8"), d.where("v > 4")
    assert tuple(evaluate.compare_sets(a, b, ["v"]).first()) == (2, 2, 1)
