"""Vocabularies and schemas of the graph, the index and the ledger (fixed values)."""

from __future__ import annotations

TYPE_KINDS = ("class", "struct", "enum", "interface", "trait", "type_alias")
#: Kinds that names resolve to.
DEFINITION_KINDS = ("file", "module", *TYPE_KINDS, "function", "method", "kernel", "component")
#: Kinds that a relation may point to; a relation that is not listed may point to any definition.
COMPATIBLE = {
    "inherits": ("class", "struct", "enum", "interface", "trait", "type_alias"),
    "extends": ("class", "struct", "enum", "interface", "trait", "type_alias"),
    "implements": ("class", "struct", "enum", "interface", "trait", "type_alias"),
    "calls": ("function", "method", "kernel", "class"),
    "binds": ("function", "method", "kernel"),
    "renders": ("component", "function", "class"),
}
EXECUTION_EDGES = ("calls", "launches", "routes_to", "binds", "renders")
SCOPE_KINDS = ("module", "class", "struct", "enum", "interface", "trait", "impl", "function", "method", "kernel")
OWNER_KINDS = ("function", "method", "kernel")

STATES = ("idle", "observing", "awaiting_authorization", "editing", "verifying", "blocked", "complete")
EVENTS = (
    "repository_synced", "map_rendered", "authorization_requested", "edit_authorized", "edit_applied", "edit_observed",
    "verification_started", "verification_passed", "verification_failed", "blocked", "completed",
)
#: Next state by event, in the order of STATES; None is a rejection.
TRANSITIONS: dict[str, tuple[str | None, ...]] = {
    "repository_synced": ("observing", "observing", "awaiting_authorization", "editing", "verifying", "observing", "observing"),
    "map_rendered": ("idle", "idle", "awaiting_authorization", "editing", "verifying", "blocked", "complete"),
    "authorization_requested": ("awaiting_authorization", "awaiting_authorization", None, None, None, "awaiting_authorization", "awaiting_authorization"),
    "edit_authorized": (None, None, "editing", None, None, None, None),
    "edit_applied": (None, None, None, "editing", None, None, None),
    "edit_observed": ("editing",) * 7,
    "verification_started": (None, None, None, "verifying", None, None, None),
    "verification_passed": (None, None, None, None, "complete", None, None),
    "verification_failed": (None, None, None, None, "blocked", None, None),
    "blocked": ("blocked",) * 7,
    "completed": ("complete",) * 7,
}

NODES = "node_id BIGINT, repo STRING, kind STRING, label STRING, qualified_name STRING, path STRING, start_line INT, end_line INT"
EDGES = "src BIGINT, dst BIGINT, kind STRING, line INT"
PENDING = "repo STRING, source_id BIGINT, target_name STRING, kind STRING, line INT"
FRAGMENT = (
    "path STRING, language STRING, content_hash BIGINT,"
    " nodes ARRAY<STRUCT<local_id: INT, kind: STRING, label: STRING, qualified_name: STRING, start_line: INT, end_line: INT, parent_local_id: INT>>,"
    " pending ARRAY<STRUCT<ord: INT, source_local_id: INT, target_name: STRING, kind: STRING, line: INT>>,"
    " local_edges ARRAY<STRUCT<ord: INT, source_local_id: INT, target_local_id: INT, kind: STRING>>"
)
