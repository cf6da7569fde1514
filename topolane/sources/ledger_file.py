"""The ledger as a JSON-lines file: decode with recovery of a cut-off last line, and append."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolane import LEDGER_VERSION
from topolane.sources.lock import Lock

SCHEMA = "version int, sequence bigint, recorded_at_ms bigint, harness string, session_id string, correlation_id string, type string, detail string, state_before string, state_after string"


def recover(path: str) -> bool:
    """Cut an unterminated last line off the file; true if there was one."""
    p = Path(path)
    if not p.exists() or not p.stat().st_size:
        return False
    with p.open("r+b") as f:
        f.seek(-1, os.SEEK_END)
        if f.read(1) == b"\n":
            return False
        # Back to the last line end, in blocks.
        end, at = f.tell(), f.tell()
        while at > 0:
            step = min(65536, at)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                end = at - step + found + 1
                break
            at -= step
            end = at
        f.truncate(end)
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of a ledger file; a line that is no event of this version fails the read."""
    recover(path)
    raw = spark.read.text(path).where("value <> ''")
    e = F.from_json("value", SCHEMA)
    checked = F.when(e["version"] == LEDGER_VERSION, e).otherwise(F.raise_error(F.concat(F.lit("corrupt ledger line: "), F.substring("value", 1, 80))))
    return raw.select(checked.alias("e")).select("e.*")


def append(path: str, events: list[dict]) -> int:
    """Append events under the lock with the next sequences; returns the last one. Events with a known correlation id are skipped."""
    with Lock(path + ".lock"):
        recover(path)
        p = Path(path)
        last, known, states = 0, set(), {}
        if p.exists():
            with p.open() as f:
                for line in f:
                    e = json.loads(line)
                    last = e["sequence"]
                    known.add(e.get("correlation_id"))
                    states[(e.get("harness"), e.get("session_id"))] = e["state_after"]
        from topolane.schemas import EVENTS, STATES, TRANSITIONS

        out = []
        for e in events:
            if e.get("correlation_id") is not None and e["correlation_id"] in known:
                continue
            lane = (e.get("harness"), e.get("session_id"))
            before = states.get(lane, "idle")
            after = TRANSITIONS[e["type"]][STATES.index(before)] if e["type"] in EVENTS else None
            if after is None:
                raise ValueError(f"{e['type']} is not possible in {before}")
            last += 1
            known.add(e.get("correlation_id"))
            states[lane] = after
            out.append({**e, "version": LEDGER_VERSION, "sequence": last, "state_before": before, "state_after": after})
        with p.open("a") as f:
            f.writelines(json.dumps(e) + "\n" for e in out)
            f.flush()
            os.fsync(f.fileno())
        return last


def hook(spark: SparkSession, path: str, agent: str, text: str, most: int = 1 << 20) -> dict | None:
    """One provider record into the ledger file; the answer to the provider, None if there is none.

    Fails open: whatever goes wrong, nothing is written and there is no answer.
    """
    from topolane.operators import hooks

    try:
        said = json.loads(text) if len(text.encode()) <= most else None
        if not isinstance(said, dict) or agent.lower() not in hooks.ROUTING:
            return None
        means = hooks.ROUTING[agent.lower()].get(said.get("hook_event_name"))
        lane = (agent.lower(), said.get("session_id") or said.get("conversation_id"))
        if means in ("context", "prompt"):
            done = read(spark, path) if Path(path).exists() else None
            n = done.count() if done is not None else 0
            if not n:
                return {}
            state = done.where((F.col("harness") == lane[0]) & F.col("session_id").eqNullSafe(F.lit(lane[1]))).agg(F.max_by("state_after", "sequence")).first()[0] or "idle"
            context = f"Session ledger:\nS{n} {''.join(w.capitalize() for w in state.split('_'))}"
            return {"additional_context": context} if lane[0] == "cursor" else {"hookSpecificOutput": {"hookEventName": said["hook_event_name"], "additionalContext": context}}
        row = spark.createDataFrame([(agent, 0, 0, 0, text)], "harness string, file_no int, line_no int, record_id int, raw string")
        with Lock(path + ".hook.lock"):
            state, done = "idle", hooks.acts(row).first()
            if done is not None and Path(path).exists():
                # One look at the ledger: the lane's state, and whether the record has acted before.
                mine = (F.col("harness") == lane[0]) & F.col("session_id").eqNullSafe(F.lit(lane[1]))
                held = read(spark, path).agg(F.max_by(F.when(mine, F.col("state_after")), F.when(mine, F.col("sequence"))), F.max(F.col("correlation_id").startswith(done.correlation + ":"))).first()
                if held[1]:
                    done = None
                state = held[0] or "idle"
            events = hooks.emit(hooks.acts(row), start=state).orderBy("step").collect() if done is not None else []
            append(path, [{"harness": r.harness, "session_id": r.session_id, "correlation_id": r.correlation, "type": r.ledger_event, "detail": r.detail} for r in events])
        return {} if means == "stop" or lane[0] == "cursor" and means else None
    except Exception:
        return None
