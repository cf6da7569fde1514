"""Session ledger: keyed replay of a state machine, validation, latest facts, projections, redaction.

Replay is a composition of functions: every event maps each of the seven states to its successor, so a stretch of events is a
vector of seven (end state, rejections). Stretches of one lane (by hour) are folded apart and then composed in order; a
lane that holds a third of all events is spread over its hours, and no task holds a whole lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolane.functions.text import redact_text
from topolane.schemas import EVENTS, STATES, TRANSITIONS

STRETCH_S = 3600


def _table() -> Column:
    """Next state by state * len(EVENTS) + event (both from 0), -1 for a rejection."""
    flat = [STATES.index(n) if (n := TRANSITIONS[e][s]) is not None else -1 for s in range(len(STATES)) for e in EVENTS]
    return F.array(*[F.lit(x) for x in flat])


def event_number(name: Column) -> Column:
    """Position in EVENTS, null for an unknown type."""
    return F.nullif(F.array_position(F.array(*[F.lit(e) for e in EVENTS]), name) - 1, F.lit(-1)).cast("int")


def state_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), number.cast("int") + 1)


def _apply(vector: Column, event: Column) -> Column:
    """One event onto a vector of (state, rejected)."""
    def one(x: Column) -> Column:
        to = F.element_at(_table(), (x["s"] * len(EVENTS) + event + 1).cast("int"))
        return F.struct(F.when(to < 0, x["s"]).otherwise(to).cast("int").alias("s"), (x["rejected"] + F.when(to < 0, 1).otherwise(0)).cast("bigint").alias("rejected"))
    return F.transform(vector, one)


def _identity() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("s"), F.lit(0).cast("bigint").alias("rejected")) for i in range(len(STATES))])


def replay(events: DataFrame, lane: list[str], at: str, tie: str, event: str, start: str = "idle") -> DataFrame:
    """(lane, state, applied, rejected, n) after all events of each lane in order of (at, tie).

    Events of unknown type, and those without a time, are counted as rejected and change nothing.
    """
    e = events.withColumn("__e", event_number(F.col(event))).withColumn("__stretch", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (STRETCH_S * 1000000)))
    known = F.col("__e").isNotNull() & F.col(at).isNotNull()
    inner = (
        e.groupBy(*lane, "__stretch")
        .agg(F.array_sort(F.collect_list(F.when(known, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col("__e").alias("e"))))).alias("es"), F.count(F.lit(1)).alias("n"), F.count(F.when(~known, 1)).alias("unknown"))
        .withColumn("v", F.aggregate("es", _identity(), lambda acc, x: _apply(acc, x["e"])))
    )
    whole = inner.groupBy(*lane).agg(F.array_sort(F.collect_list(F.struct("__stretch", "v"))).alias("vs"), F.sum("n").alias("n"), F.sum("unknown").alias("unknown"))
    first = F.struct(F.lit(STATES.index(start)).alias("s"), F.lit(0).cast("bigint").alias("rejected"))

    def step(acc: Column, x: Column) -> Column:
        end = F.element_at(x["v"], acc["s"] + 1)
        return F.struct(end["s"].alias("s"), (acc["rejected"] + end["rejected"]).alias("rejected"))

    out = whole.withColumn("end", F.aggregate("vs", first, step))
    rejected = F.col("end.rejected") + F.col("unknown")
    return out.select(*lane, state_name(F.col("end.s")).alias("state"), (F.col("n") - rejected).alias("applied"), rejected.alias("rejected"), "n")


def check_sequences(ledger: DataFrame) -> DataFrame:
    """Replay problems: wrong version, a sequence that is not contiguous from 1, states that do not follow on each other."""
    w = Window.partitionBy("lane").orderBy("sequence")
    r = ledger.withColumns({"before": F.lag("sequence").over(w), "was": F.lag("state_after").over(w)})
    problem = (
        F.when(F.col("version") != 1, "version").when(F.col("sequence") != F.coalesce(F.col("before"), F.lit(0)) + 1, "sequence")
        .when(F.col("state_before") != F.coalesce(F.col("was"), F.lit("idle")), "state")
    )
    return r.withColumn("problem", problem).where("problem is not null").select("lane", "sequence", "problem")


FACTS = (("map", ("map_rendered",)), ("edit", ("edit_applied", "edit_observed")), ("verification", ("verification_passed", "verification_failed")), ("terminal", ("blocked", "completed")))


def latest_facts(events: DataFrame, lane: list[str], order: list[str], event: str, payload: str) -> DataFrame:
    """Latest event of each group of facts in a lane: (lane, fact, event, payload); partial aggregation, no sort."""
    fact = None
    for name, kinds in FACTS:
        fact = F.when(F.col(event).isin(*kinds), name) if fact is None else fact.when(F.col(event).isin(*kinds), name)
    rows = events.withColumn("fact", fact).where("fact is not null")
    return rows.groupBy(*lane, "fact").agg(F.max(F.struct(*order, event, payload)).alias("m")).select(*lane, "fact", F.col("m")[event].alias("event"), F.col("m")[payload].alias("payload"))


def projection(facts: DataFrame, lane: list[str], limit: int = 580) -> DataFrame:
    """(lane, text, estimated_tokens): facts in their order, one line each, at most `limit` characters."""
    order = F.when(F.col("fact") == "map", 0).when(F.col("fact") == "edit", 1).when(F.col("fact") == "verification", 2).otherwise(3)
    line = F.concat_ws(" ", "event", redact_text(F.coalesce("payload", F.lit(""))))
    text = facts.groupBy(*lane).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    cut = F.when(F.char_length("text") > limit, F.concat(F.substring("text", 1, limit - 1), F.lit("…"))).otherwise(F.col("text"))
    return text.withColumn("text", cut).withColumn("estimated_tokens", F.ceil(F.char_length("text") / 4))


#: Which field of an event's payload is free text and is redacted; paths are redacted each.
FREE_TEXT = {
    "map_rendered": "query", "authorization_requested": "action", "edit_authorized": "action", "verification_started": "command",
    "verification_passed": "command", "verification_failed": "command", "blocked": "reason", "completed": "summary",
}
PAYLOAD = (
    "struct<files:bigint,changed:bigint,removed:bigint,nodes:bigint,edges:bigint,map_id:string,query:string,truncated:boolean,"
    "anchors:array<struct<visual_id:string,path:string,start_line:bigint>>,action:string,paths:array<string>,command:string,exit_code:bigint,output_bytes:bigint,reason:string,summary:string>"
)


def redact_event(event: Column, payload: Column) -> Column:
    """A payload (of type PAYLOAD) with the free text of its event redacted, and the paths of an edit."""
    out = payload
    for field in sorted(set(FREE_TEXT.values())):
        kinds = [e for e, f in FREE_TEXT.items() if f == field]
        out = out.withField(field, F.when(event.isin(*kinds), redact_text(out[field])).otherwise(out[field]))
    return out.withField("paths", F.when(event.isin("edit_applied", "edit_observed"), F.transform(out["paths"], redact_text)).otherwise(out["paths"]))


def redact_source(harness: Column, session: Column) -> tuple[Column, Column]:
    """Lane names, redacted and at most 48 and 96 characters long."""
    return F.substring(redact_text(harness), 1, 48), F.substring(redact_text(session), 1, 96)


def event_lines(event: Column, payload: Column) -> Column:
    """Lines of an event in a projection, an empty array for events that have none."""
    p = payload
    flag = lambda c: F.coalesce(c.cast("string"), F.lit("false"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    text = lambda c: F.coalesce(c, F.lit(""))
    anchors = F.array_join(F.transform(F.slice(F.coalesce(p["anchors"], F.array().cast("array<struct<visual_id:string,path:string,start_line:bigint>>")), 1, 3), lambda a: F.concat(text(a["visual_id"]), F.lit("="), text(a["path"]), F.lit(":"), number(a["start_line"]))), " ")
    code = F.when(p["exit_code"].isNotNull(), F.concat(F.lit("Some("), p["exit_code"].cast("string"), F.lit(")"))).otherwise("None")
    check = F.concat(F.lit("check "), text(p["command"]), F.lit(" success="), (event == "verification_passed").cast("string"), F.lit(" exit="), code, F.lit(" bytes="), number(p["output_bytes"]))
    return (
        F.when(event == "repository_synced", F.array(F.concat(F.lit("sync files="), number(p["files"]), F.lit(" changed="), number(p["changed"]), F.lit(" removed="), number(p["removed"]))))
        .when(event == "map_rendered", F.array(F.concat(F.lit("map "), text(p["map_id"]), F.lit(" nodes="), number(p["nodes"]), F.lit(" truncated="), flag(p["truncated"])), anchors))
        .when(event.isin("edit_applied", "edit_observed"), F.array(F.concat(F.lit("edit "), F.array_join(F.coalesce(p["paths"], F.array().cast("array<string>")), ","))))
        .when(event.isin("verification_passed", "verification_failed"), F.array(check))
        .when(event == "blocked", F.array(F.concat(F.lit("blocked "), text(p["reason"])))).when(event == "completed", F.array(F.concat(F.lit("complete "), text(p["summary"]))))
        .otherwise(F.array().cast("array<string>"))
    )


def global_state(ledger: DataFrame, project: list[str]) -> DataFrame:
    """(project, state, sequence): the state after the last event of any lane."""
    return ledger.groupBy(*project).agg(F.max_by("state_after", "sequence").alias("state"), F.max("sequence").alias("sequence"))


def session_projection(events: DataFrame, project: list[str], lane: list[str], order: list[str], states: DataFrame, event: str = "event", payload: str = "payload", limit: int = 580) -> DataFrame:
    """(project, lane, state, sequence, text, estimated_tokens) of every lane in `states` (project, lane, state).

    The head is `S`, the number of the project's events, and the lane's state; the latest map, edit, verification and
    terminal event of the project follow. `payload` is of type PAYLOAD and is redacted here.
    """
    counted = events.groupBy(*project).agg(F.count(F.lit(1)).alias("sequence"))
    rows = events.withColumn(payload, F.to_json(redact_event(F.col(event), F.col(payload))))
    facts = latest_facts(rows, project, order, event, payload).withColumn("lines", event_lines(F.col("event"), F.from_json("payload", PAYLOAD)))
    rank = F.array_position(F.array(*[F.lit(name) for name, _ in FACTS]), F.col("fact"))
    said = facts.groupBy(*project).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("o"), "lines"))), lambda x: x["lines"])).alias("facts"))
    title = F.replace(F.initcap(F.replace("state", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    out = states.join(counted, project, "left").join(said, project, "left").withColumn("sequence", F.coalesce("sequence", F.lit(0)))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("S"), F.col("sequence").cast("string"), F.lit(" "), title)), F.coalesce("facts", F.array().cast("array<string>"))), "\n")
    out = out.withColumn("text", text).withColumn("text", F.when(F.char_length("text") > limit, F.concat(F.substring("text", 1, limit - 1), F.lit("…"))).otherwise(F.col("text")))
    return out.select(*project, *lane, "state", "sequence", "text", F.ceil(F.char_length("text") / 4).alias("estimated_tokens"))


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New events whose correlation id is not stored yet and that are the first of their id; those without one pass."""
    named = new.where("correlation_id is not null")
    first = named.groupBy("correlation_id").agg(F.min(F.struct("recorded_at", *[c for c in new.columns if c not in ("correlation_id", "recorded_at")])).alias("m"))
    fresh = first.join(stored.select("correlation_id").where("correlation_id is not null").distinct(), "correlation_id", "left_anti")
    return fresh.select("correlation_id", "m.*").select(*new.columns).unionByName(new.where("correlation_id is null"))
