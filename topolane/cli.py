"""python -m topolane.cli COMMAND: index, sync, status, context, map, stats, ingest, hook over a stored index."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from topolane.project import Project
from topolane.session import get_session


def guarded(path: str, force: bool) -> str:
    """A directory to index; the root and the home directory only by force."""
    p = Path(path).resolve()
    if not p.is_dir():
        raise SystemExit(f"{p} is no directory")
    if not force and p in (Path("/"), Path.home()):
        raise SystemExit(f"{p} is not indexed without --force")
    return str(p)


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="topolane")
    a.add_argument("command", choices=["index", "sync", "status", "context", "map", "search", "stats", "ingest", "hook"])
    a.add_argument("text", nargs="?", default=".")
    a.add_argument("--path", default=".")
    a.add_argument("--store")
    a.add_argument("--out")
    a.add_argument("--budget", type=int, default=600)
    a.add_argument("--max-nodes", type=int, default=48)
    a.add_argument("--force", action="store_true")
    a.add_argument("--json", action="store_true")
    o = a.parse_args(argv)
    spark = get_session("topolane-cli")
    root = guarded(o.text if o.command in ("index", "sync") else o.path, o.force)
    store = o.store or str(Path(root) / ".topolane")
    ledger = str(Path(store) / "ledger.jsonl")
    if o.command == "hook":
        from topolane.sources import ledger_file

        Path(store).mkdir(parents=True, exist_ok=True)
        answer = ledger_file.hook(spark, ledger, o.text, sys.stdin.read((1 << 20) + 1))
        if answer is not None:
            print(json.dumps(answer))
        return 0
    if o.command == "ingest":
        from pyspark.sql import functions as F

        from topolane.operators.lifecycle import rejection, translate

        said = sys.stdin.read()
        row = spark.createDataFrame([(said,)], "raw string").select(F.from_json("raw", "version int, cwd string, source struct<harness:string,session_id:string,event_id:string>, event string").alias("e")).select("e.*").withColumnRenamed("version", "format_version")
        why = row.select(rejection().alias("w")).first().w
        events = [] if why else [r.ledger_event for r in translate(row).collect()]
        print(json.dumps({"accepted": why is None, "reason": why, "events": events}))
        return int(why is not None)
    if o.command == "sync":
        print(json.dumps(Project.sync(spark, root, store, ledger)[1]))
        return 0
    if o.command == "index":
        p = Project.index(spark, root, store)
        print(json.dumps({"files": p.files.count(), "nodes": p.nodes.count(), "edges": p.edges.count()}))
        return 0
    p = Project.open(spark, store)
    if p is None:
        print("no index; run `index` first", file=sys.stderr)
        return 1
    if o.command in ("status", "stats"):
        rows = [r.asDict() for r in p.status().orderBy("what", "name").collect()]
        print(json.dumps(rows) if o.json else "\n".join(f"{r['what']} {r['name']} {r['n']}" for r in rows))
    elif o.command == "search":
        print("\n".join(f"{r.kind} {r.label} {r.path}:{r.start_line}" for r in p.search(o.text).collect()))
    elif o.command == "context":
        print(p.context(o.text, o.budget)["text"])
    else:
        m = p.map(o.text, o.max_nodes)
        out = Path(o.out or f"{m['id']}.svg")
        out.write_text(m["svg"])
        print(json.dumps({"out": str(out), "anchors": m["anchors"], "relations": m["relations"]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
