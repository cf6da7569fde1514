"""Provider hooks: from raw records to ledger events, each depending on the state its lane is in.

What a record does is a function of the state before it: a vector of seven states and what each of them emits. A lane is
cut into stretches (one for each of its files); every stretch is composed to one vector, the vectors of a lane give the state
in which each stretch begins, and from there every stretch is walked again for its events. No task holds a whole lane.

Cases: a line that is no JSON object, an unknown harness, an event that is not handled and a shell command that verifies
nothing do nothing. A record repeated under the same correlation id acts once, in its first place. An exit code decides about
success; without one a true error flag does. Empty input gives no event; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolane.functions.text import redact_text
from topolane.operators.drift import ALIASES
from topolane.operators.lifecycle import EVENT_SCHEMA, ROUTING, correlation_id, is_verification, patch_paths, rejection, route
from topolane.schemas import STATES

#: Tools that edit and tools that run commands.
EDIT_TOOLS = ("apply_patch", "Edit", "Write", "MultiEdit", "write_file", "replace", "edit_file")
SHELL_TOOLS = ("Bash", "bash", "shell", "Shell", "run_shell_command", "terminal")

__all__ = ["EMITS", "RESPONDS", "ROUTING", "acts", "emit", "first_of_each", "respond", "walk"]

_I = {s: i for i, s in enumerate(STATES)}
#: For each thing a record does, by state: (events emitted, state after). States that are not named emit nothing and stay.
EMITS: dict[str, dict[str, tuple[tuple[str, ...], str]]] = {
    "permission": {s: (("authorization_requested",), "awaiting_authorization") for s in ("idle", "observing", "blocked", "complete")},
    "edit": {s: (("edit_authorized", "edit_applied") if s == "awaiting_authorization" else ("edit_observed",), "editing") for s in STATES},
    "passed": {"editing": (("verification_started", "verification_passed"), "complete")},
    "failed": {"editing": (("verification_started", "verification_failed"), "blocked")},
    "stop": {
        **{s: (("completed",), "complete") for s in ("idle", "observing", "editing")},
        **{s: (("blocked",), "blocked") for s in ("awaiting_authorization", "verifying")},
    },
}


#: The same for lifecycle envelopes: what is impossible in a state changes nothing there.
RESPONDS: dict[str, dict[str, tuple[tuple[str, ...], str]]] = {
    "none": {},
    "edit": {s: (("edit_observed",), "editing") for s in STATES},
    "passed": {"editing": (("verification_started", "verification_passed"), "complete")},
    "failed": {"editing": (("verification_started", "verification_failed"), "blocked")},
    "request": {s: (("authorization_requested",), "awaiting_authorization") for s in ("idle", "observing", "blocked", "complete")},
    "allow": {"awaiting_authorization": (("edit_authorized",), "editing")},
    "blocked": {s: (("blocked",), "blocked") for s in STATES},
    "completed": {s: (("completed",), "complete") for s in STATES},
}


def _next(table: dict) -> Column:
    """State after by act * 7 + state."""
    return F.array(*[F.lit(_I[table[a].get(s, ((), s))[1]]) for a in table for s in STATES])


def _events(table: dict) -> Column:
    """Events emitted by act * 7 + state."""
    return F.array(*[F.array(*[F.lit(e) for e in table[a].get(s, ((), s))[0]]).cast("array<string>") for a in table for s in STATES])


def _state(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in STATES]), (number + 1).cast("int"))


def acts(records: DataFrame, raw: str = "raw", lane: tuple[str, str] = ("harness", "session_id"), order: tuple[str, ...] = ("file_no", "line_no", "record_id")) -> DataFrame:
    """(harness, session_id, *order, act, detail, correlation): what each record does, the idle ones left out.

    The names that harnesses use for the same information are coalesced (the alias table of schema drift).
    """
    v = F.try_parse_json(F.col(raw))
    text = lambda *paths: F.coalesce(*[F.try_variant_get(v, "$." + p, "string") for p in paths])
    fields = records.select(
        F.lower("harness").alias("harness"), *order, *[text(*ALIASES[name]).alias(name) for name in ("session_id", "hook_event_name", "command")],
        text(*ALIASES["turn_id"]).alias("turn"), text(*ALIASES["tool_name"]).alias("tool"), text(*ALIASES["file_path"]).alias("file"), text(*ALIASES["tool_use_id"]).alias("use"),
        F.coalesce(*[F.try_variant_get(v, "$." + p, "bigint") for p in (*ALIASES["exit_code"], "result.exit_code")]).alias("exit_code"),
        F.coalesce(*[F.try_variant_get(v, "$." + p, "boolean") for p in ("tool_response.is_error", "tool_response.isError", "tool_response.error")], F.lit(False)).alias("error"),
    )
    means = route(F.col("harness"), F.col("hook_event_name"))
    patched = patch_paths(F.col("command"))
    paths = F.when(F.size(patched) > 0, F.array_join(patched, ",")).otherwise(F.coalesce("file", F.lit("<edit>")))
    edits = (means == "edit") | ((means == "tool") & F.coalesce(F.col("tool").isin(*EDIT_TOOLS), F.lit(False)))
    runs = means.isin("tool", "verification") & (F.coalesce(F.col("tool").isin(*SHELL_TOOLS), F.lit(False)) | F.col("command").isNotNull())
    ok = F.when(F.col("exit_code").isNotNull(), F.col("exit_code") == 0).otherwise(~F.col("error"))
    act = F.when(edits, "edit").when(runs & F.coalesce(is_verification(F.col("command")), F.lit(False)), F.when(ok, "passed").otherwise("failed")).when(means == "authorization", "permission").when(means == "stop", "stop")
    action = F.when(F.col("tool") == "apply_patch", F.concat(F.lit("edit "), paths)).otherwise(F.coalesce(F.nullif(redact_text(F.col("command")), F.lit("")), F.col("tool"), F.lit("tool")))
    detail = (
        F.when(F.col("act") == "edit", paths).when(F.col("act") == "permission", action)
        .when(F.col("act") == "stop", F.col("harness")).otherwise(redact_text(F.col("command")))
    )
    # A verification is one thing whether it passed or failed.
    name = F.when(F.col("act").isin("passed", "failed"), "verify").otherwise(F.col("act"))
    suffix = F.when(F.col("act").isin("edit", "stop"), name).otherwise(F.concat(name, F.lit(":"), F.col("detail")))
    out = fields.withColumn("act", act).where("act is not null").withColumn("detail", detail)
    out = out.withColumn("correlation", correlation_id(F.col("harness"), F.col("session_id"), F.col("turn"), F.coalesce(F.col("use"), F.lit("")), suffix))
    return out.select("harness", "session_id", *order, "act", "detail", "correlation")


def first_of_each(done: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Each correlation id once, in its first place; partial aggregation, no sort."""
    rest = [c for c in done.columns if c not in (*order, "correlation")]
    return done.groupBy("correlation").agg(F.min(F.struct(*order, *rest)).alias("m")).select("m.*", "correlation").select(*done.columns)


def walk(done: DataFrame, order: tuple[str, ...], table: dict, start: str = "idle") -> DataFrame:
    """`done` (harness, session_id, *order, act, detail, correlation) with `before`, `after` and the `events` emitted, each act
    in the order of its lane. The stretches of a lane are told apart by the first column of the order."""
    lane, stretch = ["harness", "session_id"], order[0]
    rows = done.withColumn("a", F.array_position(F.array(*[F.lit(x) for x in table]), F.col("act")) - 1)
    parts = rows.groupBy(*lane, stretch).agg(F.array_sort(F.collect_list(F.struct(*order, "a", "act", "detail", "correlation"))).alias("es"))
    to = lambda s, a: F.element_at(_next(table), (a * len(STATES) + s + 1).cast("int"))
    identity = F.array(*[F.lit(i) for i in range(len(STATES))])
    parts = parts.withColumn("vector", F.aggregate("es", identity, lambda acc, x: F.transform(acc, lambda s: to(s, x["a"]))))
    # The state in which each stretch begins, from the vectors of those before it (one row of seven numbers each).
    whole = parts.groupBy(*lane).agg(F.array_sort(F.collect_list(F.struct(F.col(stretch).alias("at"), "vector"))).alias("vs"))
    first = F.struct(F.lit(_I[start]).alias("s"), F.array().cast("array<struct<at:string,s:int>>").alias("out"))
    step = lambda acc, x: F.struct(F.element_at(x["vector"], acc["s"] + 1).alias("s"), F.concat(acc["out"], F.array(F.struct(x["at"].cast("string").alias("at"), acc["s"].alias("s")))).alias("out"))
    begins = whole.select(*[F.col(c).alias("__" + c) for c in lane], F.explode(F.aggregate("vs", first, step)["out"]).alias("b"))
    same = F.col("harness").eqNullSafe(F.col("__harness")) & F.col("session_id").eqNullSafe(F.col("__session_id")) & F.col(stretch).cast("string").eqNullSafe(F.col("b.at"))
    parts = parts.join(begins, same).withColumn("begins", F.col("b.s"))
    # Walk the stretch: the states before each act are the running ends of the acts before it.
    walked = F.aggregate("es", F.array(F.col("begins")), lambda acc, x: F.concat(acc, F.array(to(F.element_at(acc, -1), x["a"]))))
    rows = parts.select(*lane, F.explode(F.arrays_zip("es", F.slice(walked, F.lit(1), F.size("es")).alias("s"))).alias("x"))
    rows = rows.select(*lane, *[F.col("x.es." + c) for c in (*order, "a", "act", "detail", "correlation")], F.col("x.s").alias("s"))
    events = F.element_at(_events(table), (F.col("a") * len(STATES) + F.col("s") + 1).cast("int"))
    return rows.select(*lane, *order, "act", "detail", "correlation", _state(F.col("s")).alias("before"), _state(to(F.col("s"), F.col("a"))).alias("after"), events.alias("events"))


def emit(done: DataFrame, order: tuple[str, ...] = ("file_no", "line_no", "record_id"), start: str = "idle") -> DataFrame:
    """(harness, session_id, *order, step, ledger_event, detail, correlation, state_before, state_after) of acts."""
    rows = walk(first_of_each(done, order), order, EMITS, start)
    rows = rows.select("*", F.posexplode("events").alias("step", "ledger_event"))
    event = F.col("ledger_event")
    detail = F.when(event == "completed", F.concat("detail", F.lit(" turn completed"))).when(event == "blocked", F.concat("detail", F.lit(" turn stopped with pending work"))).when(event == "edit_authorized", "file edit").otherwise(F.col("detail"))
    # Two events of one record pass through the state between them.
    between = F.when(event == "edit_authorized", "editing").when(event == "verification_started", "verifying")
    return rows.select(
        "harness", "session_id", *order, "step", "ledger_event", detail.alias("detail"), F.concat_ws(":", "correlation", "ledger_event").alias("correlation"),
        F.when(F.col("step") == 0, F.col("before")).when(event == "edit_applied", "editing").otherwise("verifying").alias("state_before"), F.coalesce(between, F.col("after")).alias("state_after"),
    )


def respond(envelopes: DataFrame, event: str = "event") -> DataFrame:
    """(delivery_id, accepted, duplicate, sequence, state): the answer to every lifecycle envelope, in order of arrival.

    An envelope is a duplicate if an accepted one of its lane had its event id before, and it asks for no context; it changes
    nothing. `sequence` counts the ledger events of the project (cwd) so far, `state` is that of the lane after it. Rejected
    envelopes have no sequence and no state. `envelopes` has delivery_id, received_at, format_version, source, cwd, event.
    """
    e = F.from_json(F.col(event), EVENT_SCHEMA)
    t = e["type"]
    act = (
        F.when(t == "edit_observed", "edit").when((t == "verification_observed") & F.coalesce(e["success"], F.lit(False)), "passed").when(t == "verification_observed", "failed")
        .when(t == "authorization_requested", "request").when((t == "authorization_result") & F.coalesce(e["allowed"], F.lit(False)), "allow").when(t == "authorization_result", "blocked")
        .when((t == "turn_finished") & (e["outcome"] == "completed"), "completed").when(t.isin("turn_finished", "blocked"), "blocked").otherwise("none")
    )
    s = F.col("source")
    rows = envelopes.select(
        "delivery_id", F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp")).alias("received_at"), "cwd", rejection(event=event).isNull().alias("accepted"), act.alias("act"),
        s["harness"].alias("harness"), s["session_id"].alias("session_id"), F.concat_ws("\x00", s["harness"], s["session_id"], s["event_id"]).alias("correlation"),
    ).withColumn("stretch", F.date_trunc("hour", "received_at"))
    good = rows.where("accepted")
    order = ("stretch", "received_at", "delivery_id")
    first = good.where("act <> 'none'").groupBy("correlation").agg(F.min(F.struct("received_at", "delivery_id")).alias("m")).select("correlation", F.col("m.delivery_id").alias("first_id"))
    marked = good.join(first, "correlation", "left").withColumn("duplicate", (F.col("act") != "none") & (F.col("first_id") != F.col("delivery_id")))
    done = marked.select("harness", "session_id", *order, F.when(F.col("duplicate"), "none").otherwise(F.col("act")).alias("act"), F.col("cwd").alias("detail"), F.col("duplicate").cast("string").alias("correlation"))
    walked = walk(done, order, RESPONDS).withColumn("grown", F.size("events"))
    # Running numbers of a project: sums of the stretches before, then inside of the stretch.
    sums = walked.groupBy("detail", "stretch").agg(F.sum("grown").alias("n"))
    before = sums.select(F.col("detail").alias("p"), F.col("stretch").alias("h"), F.coalesce(F.sum("n").over(Window.partitionBy("detail").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("detail", "stretch").orderBy("received_at", "delivery_id").rowsBetween(Window.unboundedPreceding, 0)
    out = walked.withColumn("own", F.sum("grown").over(inside)).join(before, (F.col("detail") == F.col("p")) & (F.col("stretch") == F.col("h")))
    answers = out.select("delivery_id", F.lit(True).alias("accepted"), (F.col("correlation") == "true").alias("duplicate"), (F.col("base") + F.col("own")).alias("sequence"), F.col("after").alias("state"))
    bad = rows.where("not accepted").select("delivery_id", "accepted", F.lit(False).alias("duplicate"), F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("string").alias("state"))
    return answers.unionByName(bad)
