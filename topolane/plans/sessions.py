"""Queries over events, lifecycle deliveries, evidence and documents: ledger, packing, redaction, metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolane.functions import text as X
from topolane.operators import dedup, evaluate, hooks, ledger, lifecycle, packet
from topolane.schemas import EVENTS, STATES, TRANSITIONS
from topolane.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return take


#: The stand-in for ledger events: what each type of the events table means.
MEANS = {"view": "map_rendered", "click": "repository_synced", "signup": "authorization_requested", "purchase": "edit_observed", "error": "blocked"}
_MEANS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MEANS.items()) + " END"
_NEXT = "t(e, s, s2) AS (VALUES " + ", ".join(f"('{e}', '{STATES[i]}', '{n}')" for e in EVENTS for i, n in enumerate(TRANSITIONS[e]) if n is not None) + ")"
_TOKENS = r"((greatest((strlen({c}) + 2) // 3, len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'))) * 105 + 99) // 100)"


def ledger_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    name = None
    for k, v in MEANS.items():
        name = F.when(F.col("event_type") == k, v) if name is None else name.when(F.col("event_type") == k, v)
    return e.select("event_id", "ts", "user_id", name.alias("event"), "props", "value")


# ---- ledger ---------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_NEXT}, e AS (SELECT user_id, {_MEANS} AS ev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS rn, 'idle' AS s, 0::BIGINT AS rejected FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT f.user_id, e.rn, coalesce(t.s2, f.s), f.rejected + CASE WHEN t.s2 IS NULL THEN 1 ELSE 0 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1 LEFT JOIN t ON t.e = e.ev AND t.s = f.s)
SELECT f.user_id, f.s AS state, f.rejected, x.n - f.rejected AS applied, x.n FROM f JOIN (SELECT DISTINCT user_id, n FROM e) x ON x.user_id = f.user_id AND x.n = f.rn""")  # fmt: skip
def ledger_replay_state(spark, sf):
    return ledger.replay(ledger_events(spark, sf), ["user_id"], "ts", "event_id", "event")


@query(f"SELECT user_id, {_MEANS} AS event, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def ledger_lane_latest(spark, sf):
    return ledger_events(spark, sf).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event")).alias("m")).select("user_id", "m.event", "m.event_id")


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {_MEANS} AS ev, props FROM events), f AS (SELECT *, CASE WHEN ev = 'map_rendered' THEN 'map' WHEN ev = 'edit_observed' THEN 'edit' WHEN ev = 'blocked' THEN 'terminal' END AS fact FROM e)
SELECT user_id, fact, ev AS event, props AS payload FROM f WHERE fact IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, fact ORDER BY ts DESC, event_id DESC) = 1""")  # fmt: skip
def ledger_latest_facts(spark, sf):
    return ledger.latest_facts(ledger_events(spark, sf), ["user_id"], ["ts", "event_id"], "event", "props")


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {_MEANS} AS ev, props FROM events), f AS (SELECT *, CASE WHEN ev = 'map_rendered' THEN 0 WHEN ev = 'edit_observed' THEN 1 WHEN ev = 'blocked' THEN 3 END AS fact FROM e),
l AS (SELECT * FROM f WHERE fact IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, fact ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, string_agg(ev || ' ' || props, chr(10) ORDER BY fact) AS text, ceil(length(string_agg(ev || ' ' || props, chr(10) ORDER BY fact)) / 4)::BIGINT AS estimated_tokens FROM l GROUP BY 1""")  # fmt: skip
def ledger_projection(spark, sf):
    return ledger.projection(ledger.latest_facts(ledger_events(spark, sf), ["user_id"], ["ts", "event_id"], "event", "props"), ["user_id"])


@query("""WITH s AS (SELECT source.harness || ':' || source.session_id AS lane, response.sequence AS sequence, response.state AS state_after, format_version AS version,
  lag(response.sequence) OVER w AS before, lag(response.state) OVER w AS was, delivery_id, response.state AS st
  FROM lifecycle_deliveries WHERE response.sequence IS NOT NULL WINDOW w AS (PARTITION BY source.harness || ':' || source.session_id ORDER BY response.sequence, delivery_id))
SELECT CASE WHEN version <> 1 THEN 'version' WHEN sequence <> coalesce(before, 0) + 1 THEN 'sequence' ELSE 'none' END AS problem, count(*) AS n FROM s WHERE lane IS NOT NULL GROUP BY 1""")  # fmt: skip
def ledger_validate(spark, sf):
    """Problems in the sequences that receivers have handed out; states follow on each other by construction here."""
    d = table(spark, sf, "lifecycle_deliveries").where("response.sequence is not null")
    lane = F.concat(F.col("source.harness"), F.lit(":"), F.col("source.session_id"))
    w = Window.partitionBy("lane").orderBy("sequence", "delivery_id")
    r = d.select(lane.alias("lane"), F.col("response.sequence").alias("sequence"), F.col("format_version").alias("version"), "delivery_id").where("lane is not null")
    r = r.withColumn("before", F.lag("sequence").over(w))
    problem = F.when(F.col("version") != 1, "version").when(F.col("sequence") != F.coalesce("before", F.lit(0)) + 1, "sequence").otherwise("none")
    return r.groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source.harness || ':' || source.session_id || ':' || source.event_id AS correlation_id, min(delivery_id) AS first_id, count(*) AS copies FROM lifecycle_deliveries WHERE source.harness || ':' || source.session_id || ':' || source.event_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def ledger_dedup(spark, sf):
    d = table(spark, sf, "lifecycle_deliveries")
    s = F.col("source")
    c = F.concat(s["harness"], F.lit(":"), s["session_id"], F.lit(":"), s["event_id"])
    return d.withColumn("correlation_id", c).where("correlation_id is not null").groupBy("correlation_id").agg(F.min("delivery_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


# ---- lifecycle and hooks ----------------------------------------------------------------------------------------------

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_REJECT = f"""CASE WHEN coalesce(format_version <> 1, true) THEN 'version' WHEN NOT coalesce(starts_with(cwd, '/'), false) THEN 'cwd'
 WHEN coalesce(trim(source.harness, {_WHITE}) = '', true) OR length(source.harness) > 48 THEN 'harness' WHEN coalesce(trim(source.session_id, {_WHITE}) = '', true) OR length(source.session_id) > 96 THEN 'session_id'
 WHEN coalesce(trim(source.event_id, {_WHITE}) = '', true) OR length(source.event_id) > 4096 THEN 'event_id'
 WHEN NOT coalesce(json_extract_string(event, '$.type') IN ('context_requested', 'edit_observed', 'verification_observed', 'authorization_requested', 'authorization_result', 'turn_finished', 'blocked'), false) THEN 'type'
 WHEN json_extract_string(event, '$.type') = 'edit_observed' AND (coalesce(json_array_length(event, '$.paths'), 0) = 0 OR json_array_length(event, '$.paths') > 256) THEN 'paths' END"""


@query(f"SELECT delivery_id, {_REJECT} AS reason FROM lifecycle_deliveries WHERE {_REJECT} IS NOT NULL")
def lifecycle_rejected(spark, sf):
    return table(spark, sf, "lifecycle_deliveries").withColumn("reason", lifecycle.rejection()).where("reason is not null").select("delivery_id", "reason")


@query(f"""WITH d AS (SELECT *, json_extract_string(event, '$.type') AS t, json_extract_string(event, '$.success') = 'true' AS ok, json_extract_string(event, '$.allowed') = 'true' AS allowed, json_extract_string(event, '$.outcome') AS outcome FROM lifecycle_deliveries WHERE {_REJECT} IS NULL)
SELECT x AS ledger_event, count(*) AS n FROM (SELECT unnest(CASE WHEN t = 'edit_observed' THEN ['edit_observed'] WHEN t = 'verification_observed' THEN ['verification_started', CASE WHEN ok THEN 'verification_passed' ELSE 'verification_failed' END]
 WHEN t = 'authorization_requested' THEN ['authorization_requested'] WHEN t = 'authorization_result' THEN [CASE WHEN allowed THEN 'edit_authorized' ELSE 'blocked' END]
 WHEN t = 'turn_finished' THEN [CASE WHEN outcome = 'completed' THEN 'completed' ELSE 'blocked' END] WHEN t = 'blocked' THEN ['blocked'] END) AS x FROM d) WHERE x IS NOT NULL GROUP BY 1""")  # fmt: skip
def lifecycle_translate(spark, sf):
    d = table(spark, sf, "lifecycle_deliveries").where(lifecycle.rejection().isNull())
    return lifecycle.translate(d).groupBy("ledger_event").agg(F.count(F.lit(1)).alias("n"))


@query()
def lifecycle_states(spark, sf):
    """State of every session after all its messages, each counted once."""
    d = table(spark, sf, "lifecycle_deliveries").where(lifecycle.rejection().isNull())
    first = dedup.keep_first(d, dedup.message_key(), "received_at", ["delivery_id"])
    e = lifecycle.translate(first).select(F.lower(X.strip_white(F.col("source.harness"))).alias("harness"), X.strip_white(F.col("source.session_id")).alias("session_id"), "received_at", (F.col("delivery_id") * 2 + F.col("step")).alias("tie"), "ledger_event")
    return ledger.replay(e, ["harness", "session_id"], "received_at", "tie", "ledger_event")


@query(f"""WITH d AS (SELECT delivery_id, {_REJECT} IS NULL AS accepted, coalesce(received_at, TIMESTAMP '9999-12-31') AS arrived, source.harness || chr(0) || source.session_id || chr(0) || source.event_id AS id,
 coalesce(json_extract_string(event, '$.type'), '') = 'context_requested' AS context FROM lifecycle_deliveries)
SELECT delivery_id, accepted, accepted AND NOT context AND row_number() OVER (PARTITION BY accepted, context, id ORDER BY arrived, delivery_id) > 1 AS duplicate FROM d""")
def lifecycle_responses(spark, sf):
    """Answers to all deliveries; number and state, which need the order of a session, are tested against brute force."""
    d = table(spark, sf, "lifecycle_deliveries").select("delivery_id", "received_at", "format_version", "source", "cwd", "event")
    return hooks.respond(d).select("delivery_id", "accepted", "duplicate")


@query()
def hook_ledger(spark, sf):
    """Ledger events that all hook records give, each by the state of its session."""
    return hooks.emit(hooks.acts(table(spark, sf, "hook_records").select("harness", "file_no", "line_no", "record_id", "raw")))


@query()
def ledger_sessions(spark, sf):
    """Projection of every session of the hook ledger, with the facts of its harness."""
    e = hook_ledger(spark, sf).withColumn("at", F.struct("file_no", "line_no", "record_id", "step"))
    states = e.groupBy("harness", "session_id").agg(F.max_by("state_after", "at").alias("state"))
    payload = F.from_json(F.to_json(F.struct(
        F.col("detail").alias("command"), F.split("detail", ",").alias("paths"), F.col("detail").alias("reason"), F.col("detail").alias("summary"), F.col("detail").alias("action"),
    )), ledger.PAYLOAD)
    return ledger.session_projection(e.withColumn("payload", payload), ["harness"], ["session_id"], ["at"], states, "ledger_event", "payload")


# ---- packing and delivery ---------------------------------------------------------------------------------------------


@query(f"SELECT evidence_key, {_TOKENS.format(c='text')} AS tokens FROM evidence WHERE text IS NOT NULL")
def token_estimate(spark, sf):
    return table(spark, sf, "evidence").where("text is not null").select("evidence_key", X.estimate_tokens(F.col("text")).alias("tokens"))


_PACKED = rf"""
z AS (SELECT *, coalesce(text, '') AS t FROM evidence),
y AS (SELECT *, strlen(t) AS b, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')) AS r FROM z),
x AS (SELECT *, row_number() OVER w - 1 AS rank, sum(b + 1) OVER w - 1 AS sb, sum(r) OVER w AS sr FROM y WINDOW w AS (PARTITION BY query_id ORDER BY priority DESC, ord, evidence_key ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CASE WHEN sb <= 0 THEN 0 ELSE (greatest((sb + 2) // 3, sr) * 105 + 99) // 100 END AS used FROM x)"""


@query(f"WITH {_PACKED} SELECT query_id, count(*) FILTER (WHERE used <= 600) AS kept, coalesce(max(used) FILTER (WHERE used <= 600), 0)::BIGINT AS estimated_tokens, count(*) FILTER (WHERE used > 600) AS omitted, coalesce(min(rank) FILTER (WHERE used > 600), -1)::BIGINT AS next_offset FROM p GROUP BY 1")
def evidence_pack(spark, sf):
    rows = table(spark, sf, "evidence").select("evidence_key", "query_id", "ord", "priority", "text")
    out = packet.packed_summary(packet.pack_evidence(rows, ["query_id"], 600, ["ord", "evidence_key"]), ["query_id"])
    return out.withColumn("next_offset", F.coalesce("next_offset", F.lit(-1).cast("bigint")))


@query("WITH e AS (SELECT query_id, id AS item, evidence_key FROM evidence), r AS (SELECT query_id + 1 AS query_id, id AS item FROM evidence) SELECT evidence_key FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = e.query_id AND r.item = e.item)")
def delivery_delta(spark, sf):
    """Evidence that the preceding query of the session has not delivered."""
    e = table(spark, sf, "evidence").select("evidence_key", F.col("query_id").alias("session_key"), F.col("id").alias("evidence_id"))
    return packet.deliver(e, e.select((F.col("session_key") + 1).alias("session_key"), "evidence_id")).select("evidence_key")


@query("SELECT record_kind, id, evidence_key FROM evidence QUALIFY row_number() OVER (PARTITION BY record_kind ORDER BY query_id DESC, evidence_key DESC) <= 256")
def receipts_lru(spark, sf):
    r = table(spark, sf, "evidence").select(F.col("record_kind").alias("session_key"), F.col("query_id").alias("clock"), F.col("evidence_key").alias("evidence_id"), "id")
    return packet.trim_receipts(r).select(F.col("session_key").alias("record_kind"), "id", F.col("evidence_id").alias("evidence_key"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10))[1:12],
 lambda x: CASE WHEN regexp_matches(upper(x), 'API_KEY=|XAI_KEY=|TOKEN=|SECRET=|PASSWORD=|AUTHORIZATION: BEARER ') THEN '[REDACTED]' ELSE substring(x, 1, 160) END), chr(10)) AS redacted FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def redact_documents(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", X.redact_text(F.col("text")).alias("redacted"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'resume|continue|pick up|blocked|failed|failure') THEN 'resume' WHEN regexp_matches(lower(text), 'change|changed|impact|worktree|affected|tests') THEN 'change'
 WHEN starts_with(lower(text), 'how ') OR regexp_matches(lower(text), ' flow | reach | path | calls ') THEN 'flow' WHEN regexp_matches(lower(text), 'source|implementation|inspect|show code|read ') THEN 'inspect' ELSE 'locate' END AS intent FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def classify_intent(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", X.classify_intent(F.col("text")).alias("intent"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value < 10) AS lt_10, count(*) FILTER (WHERE value >= 10 AND value < 100) AS lt_100, count(*) FILTER (WHERE value >= 100 AND value < 1000) AS lt_1000, count(*) FILTER (WHERE value >= 1000) AS ge_1000 FROM events GROUP BY 1")
def metrics_latency_buckets(spark, sf):
    return packet.metrics(table(spark, sf, "events"), "event_type", "value")


# ---- batching and evaluation --------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS batch FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY user_id, batch""")  # fmt: skip
def session_gap_batches(spark, sf):
    """Quiet-period batches of each lane."""
    return evaluate.quiet_batches(table(spark, sf, "events"), "user_id", "ts", 1800).select("user_id", "first_ts", "last_ts", "n")


@query("SELECT record_kind, quantile_disc(length(text), 0.5)::BIGINT AS median, quantile_disc(length(text), 0.75)::BIGINT AS p75, count(*) AS n FROM evidence WHERE text IS NOT NULL GROUP BY 1")
def gate_percentiles(spark, sf):
    e = table(spark, sf, "evidence").where("text is not null").withColumn("size", F.char_length("text"))
    return evaluate.nearest_rank(e, "record_kind", "size", {"median": 0.5, "p75": 0.75})


@query(f"WITH {_PACKED} SELECT query_id, count(*) AS expected, count(*) FILTER (WHERE used <= 600) AS found, round(count(*) FILTER (WHERE used <= 600) / count(*), 6) AS recall FROM p WHERE record_kind = 'anchor' GROUP BY 1")
def anchor_recall(spark, sf):
    """Share of a query's anchors that are in its packet."""
    rows = table(spark, sf, "evidence").select("evidence_key", "query_id", "ord", "priority", "text", "record_kind")
    return evaluate.recall(packet.pack_evidence(rows, ["query_id"], 600, ["ord", "evidence_key"]).where("record_kind = 'anchor'"), ["query_id"], "kept")


@query(r"SELECT file_id, line_no, substring(x, 1, 200) AS line FROM (SELECT file_id, unnest(t) AS x, unnest(generate_series(1, len(t))) AS line_no FROM (SELECT file_id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM source_files WHERE content IS NOT NULL)) WHERE contains(x, 'ledger')")
def literal_search(spark, sf):
    return evaluate.literal_search(table(spark, sf, "source_files").select("file_id", "content"), "content", "ledger").select("file_id", "line_no", "line")


@query(r"SELECT record_id, array_to_string(list_sort(list_distinct(regexp_extract_all(c, '\*\*\* (?:Add|Update|Delete) File: ([^\r\n]+)', 1))), ',') AS paths FROM (SELECT record_id, json_extract_string(raw, '$.tool_input.command') AS c FROM hook_records WHERE json_valid(raw)) WHERE contains(c, '*** ') AND len(regexp_extract_all(c, '\*\*\* (?:Add|Update|Delete) File: ([^\r\n]+)', 1)) > 0")
def hook_patch_paths(spark, sf):
    c = F.try_variant_get(F.try_parse_json(F.col("raw")), "$.tool_input.command", "string")
    p = table(spark, sf, "hook_records").select("record_id", lifecycle.patch_paths(c).alias("p")).where("size(p) > 0")
    return p.select("record_id", F.array_join("p", ",").alias("paths"))


@query("""SELECT harness, json_extract_string(raw, '$.hook_event_name') AS event, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(coalesce(json_extract_string(raw, '$.tool_input.command'), '')), 'cargo test|cargo check|cargo clippy|cargo build|npm test|npm run test|pnpm test|yarn test|pytest|go test|swift test')) AS checks
FROM hook_records WHERE json_valid(raw) AND json_extract_string(raw, '$.hook_event_name') IS NOT NULL GROUP BY ALL""")  # fmt: skip
def hook_events(spark, sf):
    v = F.try_parse_json(F.col("raw"))
    r = table(spark, sf, "hook_records").select("harness", F.try_variant_get(v, "$.hook_event_name", "string").alias("event"), F.try_variant_get(v, "$.tool_input.command", "string").alias("command"))
    return r.where("event is not null").groupBy("harness", "event").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(lifecycle.is_verification(F.col("command")), 1)).alias("checks"))
