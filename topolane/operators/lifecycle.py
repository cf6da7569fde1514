"""Lifecycle envelopes and provider hooks: validation, translation to ledger events, field coalescing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolane.functions.text import contains_any, strip_white

#: Fixed values.
VERIFY_WORDS = ("cargo test", "cargo check", "cargo clippy", "cargo build", "npm test", "npm run test", "pnpm test", "yarn test", "pytest", "go test", "swift test")
EVENT_TYPES = ("context_requested", "edit_observed", "verification_observed", "authorization_requested", "authorization_result", "turn_finished", "blocked")
EVENT_SCHEMA = "type string, action string, allowed boolean, paths array<string>, command string, success boolean, exit_code int, output_bytes bigint, outcome string, summary string, reason string"


def rejection(source: str = "source", cwd: str = "cwd", version: str = "format_version", event: str = "event") -> Column:
    """Why an envelope is rejected, null if it is accepted. (That the directory exists is for the caller to know.)"""
    s = F.col(source)
    e = F.from_json(F.col(event), EVENT_SCHEMA)
    blank = lambda c: F.coalesce(strip_white(c) == "", F.lit(True))
    n = F.size(F.coalesce(e["paths"], F.array().cast("array<string>")))
    long = F.lit(False)
    for c in (e["action"], e["command"], e["summary"], e["reason"]):
        long = long | F.coalesce(F.char_length(c) > 4096, F.lit(False))
    return (
        F.when(F.octet_length(event) > 1048576, "size").when(F.coalesce(F.col(version) != 1, F.lit(True)), "version")
        .when(~F.coalesce(F.col(cwd).startswith("/"), F.lit(False)), "cwd")
        .when(blank(s["harness"]) | (F.char_length(s["harness"]) > 48), "harness").when(blank(s["session_id"]) | (F.char_length(s["session_id"]) > 96), "session_id")
        .when(blank(s["event_id"]) | (F.char_length(s["event_id"]) > 4096), "event_id").when(~F.coalesce(e["type"].isin(*EVENT_TYPES), F.lit(False)), "type")
        .when((e["type"] == "edit_observed") & ((n == 0) | (n > 256)), "paths").when(long, "length")
    )


def translate(envelopes: DataFrame, event: str = "event") -> DataFrame:
    """One row for each ledger event of an envelope, with `step` (from 0), `ledger_event` and `detail`; context requests give none."""
    e = F.from_json(F.col(event), EVENT_SCHEMA)
    one = lambda name, detail: F.array(F.struct(F.lit(name).alias("ledger_event"), detail.cast("string").alias("detail")))
    t = e["type"]
    rows = (
        F.when(t == "edit_observed", one("edit_observed", F.array_join(e["paths"], ",")))
        .when(t == "verification_observed", F.concat(one("verification_started", e["command"]), F.when(e["success"], one("verification_passed", e["command"])).otherwise(one("verification_failed", e["command"]))))
        .when(t == "authorization_requested", one("authorization_requested", e["action"]))
        .when((t == "authorization_result") & e["allowed"], one("edit_authorized", e["action"])).when(t == "authorization_result", one("blocked", F.concat(F.lit("authorization denied: "), e["action"])))
        .when((t == "turn_finished") & (e["outcome"] == "completed"), one("completed", e["summary"])).when(t == "turn_finished", one("blocked", e["summary"]))
        .when(t == "blocked", one("blocked", e["reason"]))
    )
    return envelopes.select("*", F.posexplode(rows).alias("step", "x")).select("*", "x.ledger_event", "x.detail").drop("x")


def is_verification(command: Column) -> Column:
    return contains_any(F.lower(command), VERIFY_WORDS)


def patch_paths(text: Column, most: int = 256) -> Column:
    """Sorted distinct paths of a patch's Add, Update and Delete File lines."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: ([^\r\n]+)$"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def correlation_id(harness: Column, session: Column, turn: Column, event: Column, suffix: Column) -> Column:
    """harness:session:turn:event:suffix; a digest where a part is missing."""
    parts = [harness, session, turn, event, suffix]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws(":", *parts)).otherwise(F.sha2(F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


#: Meaning of provider events: (harness, event) to what the hook does.
ROUTING = {
    "codex": {"SessionStart": "context", "PermissionRequest": "authorization", "PostToolUse": "tool", "Stop": "stop", "UserPromptSubmit": "prompt"},
    "claude": {"SessionStart": "context", "PostToolUse": "tool", "Stop": "stop", "UserPromptSubmit": "prompt"},
    "gemini": {"SessionStart": "context", "AfterTool": "tool", "AfterAgent": "stop", "BeforeAgent": "prompt"},
    "cursor": {"sessionStart": "context", "afterFileEdit": "edit", "afterShellExecution": "verification", "stop": "stop"},
}


def route(harness: Column, event: Column) -> Column:
    """What a provider event means, null if it is not handled."""
    out = None
    for h, events in ROUTING.items():
        for e, meaning in events.items():
            hit = (harness == h) & (event == e)
            out = F.when(hit, meaning) if out is None else out.when(hit, meaning)
    return out


def find_key(raw: Column, names: list[str]) -> Column:
    """First scalar under any of the names anywhere in a JSON text, as JSON text; null if there is none or it is no JSON."""
    wanted = set(names)

    def look(value: object) -> object:
        if isinstance(value, dict):
            for k, v in value.items():
                if k in wanted and not isinstance(v, (dict, list)) and v is not None:
                    return v
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            if (got := look(v)) is not None:
                return got
        return None

    def one(text: str | None) -> str | None:
        try:
            got = look(json.loads(text))
        except (ValueError, TypeError, RecursionError):
            return None
        return None if got is None else json.dumps(got)

    @F.pandas_udf("string")
    def found(s: pd.Series) -> pd.Series:
        return s.map(one)

    return found(raw)
