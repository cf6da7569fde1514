"""A selection as a picture: strongly connected components, grid layout, SVG and legend. All on at most 96 nodes."""

from __future__ import annotations

import hashlib
from html import escape


def components(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """Number of the strongly connected component of each node; numbers follow the smallest member."""
    out: dict[int, list[int]] = {n: [] for n in nodes}
    back: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        if a in out and b in out:
            out[a].append(b)
            back[b].append(a)
    order, seen = [], set()
    for n in nodes:
        if n in seen:
            continue
        stack = [(n, iter(out[n]))]
        seen.add(n)
        while stack:
            at, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(at)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(out[step])))
    group: dict[int, int] = {}
    for n in reversed(order):
        if n in group:
            continue
        todo, members = [n], {n}
        while todo:
            for x in back[todo.pop()]:
                if x not in group and x not in members:
                    members.add(x)
                    todo.append(x)
        for m in members:
            group[m] = min(members)
    number = {m: i for i, m in enumerate(sorted(set(group.values())))}
    return {n: number[group[n]] for n in nodes}


def layout(rows: list[dict], edges: list[tuple[int, int]], columns: int = 6) -> list[dict]:
    """Rows in drawing order, with col and row: by distance, component, path and id, column after column."""
    scc = components([r["node_id"] for r in rows], edges)
    ordered = sorted(rows, key=lambda r: (r["distance"], scc[r["node_id"]], r["path"] or "", r["node_id"]))
    wide = max(1, min(columns, len(ordered)))
    tall = -(-len(ordered) // wide)
    return [r | {"col": i // tall, "row": i % tall, "scc": scc[r["node_id"]]} for i, r in enumerate(ordered)]


def svg(rows: list[dict], edges: list[tuple[int, int, str]], width: int = 1536, height: int = 1024) -> str:
    """Deterministic drawing; anchors have a thick frame, uncertain relations are dashed amber. It holds no source."""
    placed = layout(rows, [(a, b) for a, b, _ in edges])
    wide = max((r["col"] for r in placed), default=0) + 1
    tall = max((r["row"] for r in placed), default=0) + 1
    dx, dy = width / wide, height / tall
    at = {r["node_id"]: (r["col"] * dx + dx / 2, r["row"] * dy + dy / 2) for r in placed}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">', f'<rect width="{width}" height="{height}" fill="#ffffff"/>']
    for a, b, kind in sorted(set(edges)):
        if a in at and b in at and kind != "contains":
            look = 'stroke="#d97706" stroke-dasharray="6 4"' if kind.startswith("uncertain_") else 'stroke="#64748b"'
            out.append(f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" {look}/>')
    for i, r in enumerate(placed):
        x, y = at[r["node_id"]]
        w, h = min(220.0, dx * 0.9), min(48.0, dy * 0.8)
        out.append(f'<rect x="{x - w / 2:.1f}" y="{y - h / 2:.1f}" width="{w:.1f}" height="{h:.1f}" rx="6" fill="#f8fafc" stroke="#0f172a" stroke-width="{4 if r["is_anchor"] else 1}"/>')
        out.append(f'<text x="{x:.1f}" y="{y + 4:.1f}" font-size="12" text-anchor="middle">N{i + 1} {escape(str(r["label"])[:28])}</text>')
    return "\n".join([*out, "</svg>"])


def legend(rows: list[dict], edges: list[tuple[int, int, str]], most: int = 16) -> tuple[list[tuple], list[tuple]]:
    """(visual id, label, path, line) of the anchors, and up to `most` distinct relations between anchors, without loops."""
    placed = layout(rows, [(a, b) for a, b, _ in edges])
    name = {r["node_id"]: f"N{i + 1}" for i, r in enumerate(placed)}
    anchors = {r["node_id"] for r in placed if r["is_anchor"]}
    marks = [(name[r["node_id"]], r["label"], r["path"], r["start_line"]) for r in placed if r["is_anchor"]]
    links = sorted({(name[a], kind, name[b]) for a, b, kind in edges if a in anchors and b in anchors and a != b and kind != "contains"})
    return marks, links[:most]


def artifact_id(question: str) -> str:
    h = 0xCBF29CE484222325
    for b in question.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"topology-{h:016x}"


def checksum(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
