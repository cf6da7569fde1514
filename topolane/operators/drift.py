"""Schemas that drift between the files of a feed: a column lifespan catalogue, the changes, and one consistent table.

Each readable line is reduced on the JVM to its schema (a "footer"); footers are counted per file with map-side
aggregation, and only the few distinct ones per file are exploded to (field, type) rows. Lifespans are islands: windows
with `lag` over the numbered files of a feed find the stretches in which a field has a type; renamings from an alias table and from names that begin where the same
other name ends in many feeds, casts from the same table.

Cases: a line that is no JSON object (null, cut off, empty, a bare array or number) has no fields but its file still
counts; a null file number or feed makes a group of its own; repeated and late lines change nothing; null values do not
occur; an empty table gives no change. Extra columns are ignored.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topolane.session import cut

#: Names under which the harnesses deliver the same information; the first is the name in the unified table.
ALIASES: dict[str, tuple[str, ...]] = {
    "session_id": ("session_id", "sessionId", "conversation_id", "conversationId", "chat_id", "thread_id", "composer.id"),
    "turn_id": ("turn_id", "turnId", "turn"),
    "hook_event_name": ("hook_event_name", "event_name", "hookEventName", "hook.event", "event"),
    "cwd": ("cwd", "working_dir", "workdir", "project_dir", "workspace", "workspace_roots"),
    "tool_name": ("tool_name", "toolName", "function_name", "tool", "name"),
    "tool_use_id": ("tool_use_id", "toolUseId", "call_id", "use_id"),
    "file_path": (
        "tool_input.file_path", "tool_input.filePath", "tool_input.path", "tool_input.absolute_path", "tool_input.target_file",
        "file_path", "filePath", "path", "edit.file_path",
    ),
    "command": ("tool_input.command", "tool_input.cmd", "tool_input.patch_text", "command", "cmd", "shell_command", "shell.command"),
    "content": ("tool_input.content", "tool_input.text", "tool_input.file_text", "tool_input.contents"),
    "old_string": ("tool_input.old_string", "tool_input.before", "tool_input.oldString"),
    "new_string": ("tool_input.new_string", "tool_input.after", "tool_input.newString"),
    "output": (
        "tool_response.output", "tool_response.stdout", "tool_response.result", "tool_response.llmContent", "tool_response.llm_content",
        "llmContent", "output", "stdout", "shell.output",
    ),
    "exit_code": (
        "tool_response.exit_code", "tool_response.exitCode", "tool_response.code", "tool_response.returncode", "exit_status",
        "exit_code", "exitCode", "shell.exit_code",
    ),
    "success": ("tool_response.success", "tool_response.ok", "succeeded"),
    "error": ("tool_response.error", "tool_response.failed"),
    "prompt": ("prompt", "user_prompt", "input.prompt", "userPrompt"),
    "last_message": ("last_assistant_message", "lastMessage", "assistant_text", "lastAssistantMessage", "prompt_response", "promptResponse", "response_text"),
    "stop_hook_active": ("stop_hook_active", "stopHookActive"),
    "status": ("status", "stop_status", "outcome"),
    "source": ("source", "start_source"),
    "permission_mode": ("permission_mode", "permissionMode"),
}

#: An alias is learned from the feeds if a new name meets the same ending name in so many of them, and in this share of its births.
LEAST_FEEDS, LEAST_SHARE = 5, 0.5

TYPES = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DATE": "string", "BINARY": "string", "UUID": "string"}


def parse_schema(text: str) -> list[tuple[str, str]]:
    """(dotted path, JSON type) of each value in a variant schema such as OBJECT<a: STRING, b: OBJECT<c: BIGINT>>."""
    out: list[tuple[str, str]] = []
    pos = 0

    def name() -> str:
        nonlocal pos
        if text[pos] == "`":
            end, got = pos + 1, []
            while True:
                if text[end] == "`":
                    if text.startswith("``", end):
                        got.append("`")
                        end += 2
                        continue
                    break
                got.append(text[end])
                end += 1
            pos = end + 1
            return "".join(got)
        end = text.index(":", pos)
        got = text[pos:end]
        pos = end
        return got

    def skip() -> None:
        """Past a type without reporting what is in it."""
        nonlocal pos
        depth = 0
        while pos < len(text):
            ch = text[pos]
            if ch == "`":
                name()
                continue
            if ch in "<(":
                depth += 1
            elif ch in ">)":
                if depth == 0:
                    return
                depth -= 1
            elif ch == "," and depth == 0:
                return
            pos += 1

    def kind(path: str) -> None:
        nonlocal pos
        if text.startswith("OBJECT", pos):
            pos += 6
            if path:
                out.append((path, "object"))
            if not text.startswith("<", pos):
                return
            pos += 1
            while text[pos] != ">":
                n = name()
                pos += 2  # colon and blank
                kind(f"{path}.{n}" if path else n)
                if text.startswith(", ", pos):
                    pos += 2
            pos += 1
            return
        word = text[pos:]
        if text.startswith("ARRAY", pos):
            out.append((path, "array"))
        else:
            first = word.split("<")[0].split(",")[0].split(">")[0].split("(")[0].strip()
            out.append((path, TYPES.get(first, "string" if first.startswith("TIMESTAMP") else "number")))
        skip()

    if text.startswith("OBJECT<"):
        kind("")
    return out


def footers(lines: DataFrame, feed: str = "feed_id", file: str = "file_no", raw: str = "raw") -> DataFrame:
    """Distinct line schemas of each file with their number of lines; unreadable lines have a null footer.

    The text of the keys is reduced to a schema string on the JVM, and counting combines before the shuffle, so what
    moves is a few rows a file, however many lines a feed or file has.
    """
    footer = F.schema_of_variant(F.try_parse_json(F.col(raw)))
    return (
        lines.select(F.col(feed).alias("feed_id"), F.col(file).alias("file_no"), F.when(footer.startswith("OBJECT"), footer).alias("footer"))
        .groupBy("feed_id", "file_no", "footer")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


def exploded(footer_rows: DataFrame) -> DataFrame:
    """(feed_id, file_no, n_lines, field, type) of every value named in the footers; a footer is parsed once a batch."""
    schema = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("type", T.StringType())]))

    @F.pandas_udf(schema)
    def fields(s: pd.Series) -> pd.Series:
        seen: dict[str, list] = {}
        return s.map(lambda x: seen.setdefault(x, parse_schema(x)) if x is not None and x not in seen else seen.get(x, []))

    return footer_rows.withColumn("f", F.explode(fields("footer"))).select("feed_id", "file_no", "n_lines", "f.field", "f.type")


def alias_groups(spark) -> DataFrame:
    """(field, meaning, rank) of the alias table; its size is that of the table above."""
    rows = [(name, meaning, i) for meaning, names in ALIASES.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "field string, meaning string, alias_rank int")


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null is a value like others."""
    right = right.withColumnsRenamed({k: "__" + k for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("__" + k))
    return left.join(right, same, how).drop(*["__" + k for k in keys])


def islands(lines: DataFrame) -> DataFrame:
    """Lifespans: one row for each stretch of consecutive files in which a field of a feed occurs with a JSON type.

    Columns: feed_id, field, type, island (from 1), from_file, to_file, n_files, n_lines, first_file (of the feed), next_file
    (the feed's file after `to_file`, null at its end): a field that goes and comes back has two.
    """
    # Lineage is cut here so that the lines are parsed once: what is kept are the distinct footers of each file.
    foot = cut(footers(lines))
    numbered = Window.partitionBy("feed_id").orderBy("file_no")
    files = foot.select("feed_id", "file_no").distinct()
    files = files.withColumns({"at": F.row_number().over(numbered), "next_file": F.lead("file_no").over(numbered), "first_file": F.min("file_no").over(Window.partitionBy("feed_id"))})
    rows = exploded(foot).where("type <> 'null'").groupBy("feed_id", "file_no", "field", "type").agg(F.sum("n_lines").alias("n_lines"))
    rows = _beside(rows, files, ["feed_id", "file_no"])
    span = Window.partitionBy("feed_id", "field", "type").orderBy("at")
    rows = rows.withColumn("starts", F.when(F.lag("at").over(span) == F.col("at") - 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("starts").over(span))
    return rows.groupBy("feed_id", "field", "type", "island").agg(
        F.min("file_no").alias("from_file"), F.max("file_no").alias("to_file"), F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"),
        F.first("first_file").alias("first_file"), F.max_by("next_file", "at").alias("next_file"),
    )


def catalogue(lines: DataFrame) -> DataFrame:
    """One row for each field of a feed and JSON type: first and last file, and the file that follows the last one.

    Columns: feed_id, field, type, type_first (first file with this type), born, last (files of the field over all
    types), first_file (of the feed), after (the feed's next file after `last`, null if none), n_lines.
    """
    per = islands(lines).groupBy("feed_id", "field", "type").agg(
        F.min("from_file").alias("type_first"), F.max("to_file").alias("type_last"), F.sum("n_lines").alias("n_lines"),
        F.first("first_file").alias("first_file"), F.max_by("next_file", "to_file").alias("next_file"),
    )
    whole = Window.partitionBy("feed_id", "field")
    per = per.withColumns({
        "born": F.min("type_first").over(whole), "last": F.max("type_last").over(whole), "after": F.max_by("next_file", "type_last").over(whole),
        "is_field": F.max(F.when(F.col("type") != "object", 1).otherwise(0)).over(whole),
        "was_object": F.max(F.when(F.col("type") == "object", 1).otherwise(0)).over(whole),
    })
    fields = per.where("is_field = 1")
    # A field that becomes an object hides what is below it: members are dropped by an anti-join on their ancestors.
    opened = fields.where("was_object = 1").select("feed_id", F.col("field").alias("ancestor")).distinct()
    parts = F.split("field", r"\.", -1)
    below = (
        fields.select("feed_id", "field").distinct().where(F.instr("field", ".") > 0)
        .withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))))
        .join(opened, ["feed_id", "ancestor"], "left_semi").select("feed_id", "field").distinct()
    )
    fields = fields.join(below, ["feed_id", "field"], "left_anti")
    return fields.select("feed_id", "field", "type", "type_first", "born", "last", "first_file", "after", "n_lines")


def changes(lines: DataFrame) -> DataFrame:
    """(feed_id, file_no, change, field, new_field): additions, removals, renamings and new types of every feed."""
    spark = lines.sparkSession
    cat = cut(catalogue(lines))
    spans = cat.select("feed_id", "field", "born", "last", "first_file", "after").distinct()
    alias = F.broadcast(alias_groups(spark))  # bounded by the alias table in this module
    start = spans.where("born <> first_file").select("feed_id", F.col("born").alias("file_no"), F.col("field").alias("new_field"))
    end = spans.where("after is not null").select("feed_id", F.col("after").alias("file_no"), "field")
    folded = lambda c: F.lower(F.regexp_replace(c, "[_\\-]", ""))
    s = start.join(alias.select(F.col("field").alias("new_field"), F.col("meaning").alias("m2"), F.col("alias_rank").alias("r2")), "new_field", "left")
    e = end.join(alias.select("field", F.col("meaning").alias("m1"), F.col("alias_rank").alias("r1")), "field", "left")
    # Same meaning by the table, or (names that it lacks) the same name in another spelling.
    s = s.withColumn("meaning", F.coalesce("m2", folded(F.col("new_field"))))
    e = e.withColumn("meaning", F.coalesce("m1", folded(F.col("field"))))
    pair = e.join(s, ["feed_id", "file_no", "meaning"])
    one_to_one = lambda df, r1, r2: (
        df.withColumns({
            "a": F.row_number().over(Window.partitionBy("feed_id", "file_no", "field").orderBy(r2, "new_field")),
            "b": F.row_number().over(Window.partitionBy("feed_id", "file_no", "new_field").orderBy(r1, "field")),
        }).where("a = 1 and b = 1").select("feed_id", "file_no", F.lit("renamed").alias("change"), "field", "new_field")
    )
    told = cut(one_to_one(pair, F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last()))
    # Names that the table lacks: a name that is mostly born where the same other name ends, in several feeds, is its alias.
    open_start = start.join(told.select("feed_id", "file_no", "new_field"), ["feed_id", "file_no", "new_field"], "left_anti")
    open_end = end.join(told.select("feed_id", "file_no", "field"), ["feed_id", "file_no", "field"], "left_anti")
    met = cut(open_end.join(open_start, ["feed_id", "file_no"]))
    births = start.groupBy("new_field").agg(F.count(F.lit(1)).alias("births"))
    learned = met.groupBy("field", "new_field").agg(F.count(F.lit(1)).alias("together")).join(births, "new_field")
    learned = learned.where((F.col("together") >= LEAST_FEEDS) & (F.col("together") >= LEAST_SHARE * F.col("births"))).select("field", "new_field", "together")
    renamed = told.unionByName(one_to_one(met.join(learned, ["field", "new_field"]), F.col("together").desc(), F.col("together").desc()))
    added = start.join(renamed.select("feed_id", "file_no", "new_field"), ["feed_id", "file_no", "new_field"], "left_anti")
    removed = end.join(renamed.select("feed_id", "file_no", "field"), ["feed_id", "file_no", "field"], "left_anti")
    retyped = cat.where("type_first <> born").select("feed_id", F.col("type_first").alias("file_no"), "field").distinct()
    shape = lambda df, kind, col: df.select("feed_id", "file_no", F.lit(kind).alias("change"), F.col(col).alias("field"), F.lit("").alias("new_field"))
    return renamed.unionByName(shape(added, "added", "new_field")).unionByName(shape(removed, "removed", "field")).unionByName(shape(retyped, "retyped", "field"))


#: Type of each column of the unified table that is not text.
CASTS = {"exit_code": "bigint", "success": "boolean", "error": "boolean", "stop_hook_active": "boolean"}


#: Members that hold the value where it became an object.
MEMBERS = {"output": ("text",), "content": ("text",), "cwd": ("primary",)}

#: Column and rank of every path of the alias table; the smallest rank has the column where a line has several.
PLACES = {
    path: (meaning, rank)
    for meaning, names in ALIASES.items()
    for rank, path in enumerate(p for n in names for p in (*(f"{n}.{m}" for m in MEMBERS.get(meaning, ())), n))
}
UNIFIED = "struct<readable:boolean," + ",".join(f"u_{m}:{CASTS.get(m, 'string')}" for m in ALIASES) + ",rest:map<string,string>>"


class _Number(str):
    """A number as it is written in the line."""


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key twice")
    return out


def _not_json(word: str) -> None:
    raise ValueError(word)


def _text(value: object) -> str:
    """JSON text of a decoded value."""
    if isinstance(value, _Number):
        return value
    if isinstance(value, list):
        return "[" + ",".join(map(_text, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def leaves(value: dict) -> list[tuple[str, object]]:
    """(dotted path, value) of every value that is neither null nor an object with members, in their order."""
    out, stack = [], [("", iter(value.items()))]
    while stack:
        path, items = stack[-1]
        for k, v in items:
            at = f"{path}.{k}" if path else k
            if isinstance(v, dict) and v:
                stack.append((at, iter(v.items())))
                break
            if v is not None:
                out.append((at, v))
        else:
            stack.pop()
    return out


def _cast(value: object, kind: str) -> object:
    """The value in the column's type, None where it has none."""
    text = value if isinstance(value, str) else _text(value)
    if kind == "string":
        return text
    if kind == "boolean":
        return {"true": True, "1": True, "false": False, "0": False}.get(text.strip().lower())
    try:
        number = int(text) if text.strip().lstrip("+-").isdigit() else Decimal(text)
        return int(number) if number == int(number) and -(2**63) <= number < 2**63 else None
    except (ArithmeticError, ValueError):
        return None


def unify_line(raw: str | None) -> dict:
    """One line of the unified table."""
    try:
        value = json.loads(raw, parse_int=_Number, parse_float=_Number, parse_constant=_not_json, object_pairs_hook=_pairs)
    except (ValueError, TypeError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return {"readable": False, "rest": {}}
    out, taken, rest = {"readable": True}, {}, {}
    for path, v in leaves(value):
        place = PLACES.get(path) if v != {} else None
        if place is not None and (cast := _cast(v, CASTS.get(place[0], "string"))) is not None:
            meaning, rank = place
            held = taken.get(meaning)
            if held is None or rank < held[0]:
                taken[meaning] = (rank, path, v)
                out["u_" + meaning] = cast
                if held is None:
                    continue
                path, v = held[1:]
        while path in rest:
            path += "'"
        rest[path] = _text(v)
    out["rest"] = rest
    return out


def unified(lines: DataFrame) -> DataFrame:
    """All lines in one table that holds every value: the alias table's columns with their casts, and `rest`.

    A value that became an object gives its `text` or `primary` member, an array its JSON text. `rest` maps the path of
    every other value to its JSON text: fields that the alias table lacks, a second name of the same information in a
    line, and values that the column's type cannot hold. `readable` is false where the line is no JSON object. Row for
    row, no shuffle.
    """
    names = ["readable", *("u_" + m for m in ALIASES), "rest"]

    @F.pandas_udf(UNIFIED)
    def unify(raw: pd.Series) -> pd.DataFrame:
        rows = [unify_line(x) for x in raw]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return lines.select(*[F.col(c) for c in lines.columns], unify("raw").alias("__u")).select(*lines.columns, "__u.*")


def values(lines: DataFrame) -> DataFrame:
    """(feed_id, file_no, n_in, n_out): values in the lines of a file, by their footers, and in the unified table."""
    counted = exploded(footers(lines)).where("type not in ('null', 'object')").groupBy("feed_id", "file_no").agg(F.sum("n_lines").alias("n_in"))
    held = F.size(F.map_filter("rest", lambda _, v: v != "{}"))
    for m in ALIASES:
        held = held + F.col("u_" + m).isNotNull().cast("int")
    out = unified(lines.select("feed_id", "file_no", "raw")).groupBy("feed_id", "file_no").agg(F.sum(held).alias("n_out"))
    return _beside(out, counted, ["feed_id", "file_no"], "left").select("feed_id", "file_no", F.coalesce("n_in", F.lit(0)).alias("n_in"), "n_out")
