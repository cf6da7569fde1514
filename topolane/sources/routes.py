"""Framework routes and client bridges in source files: (kind, label, line, target)."""

from __future__ import annotations

import re
from collections.abc import Iterator

VERBS = "get|post|put|patch|delete|options|head|all|use"
#: What a resource declaration stands for.
REST_ACTIONS = (("GET", "", "index"), ("GET", "/new", "new"), ("POST", "", "create"), ("GET", "/:id", "show"), ("GET", "/:id/edit", "edit"), ("PATCH", "/:id", "update"), ("DELETE", "/:id", "destroy"))

Found = tuple[str, str, int, str | None]


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """Top-level arguments of the call whose parenthesis opens at `at`, and the end; quotes and nesting are respected."""
    depth, quote, start, out = 0, "", at + 1, []
    i = at
    while i < len(text):
        ch = text[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'`":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if depth == 0:
                out.append(text[start:i].strip())
                return [a for a in out if a], i
        elif ch == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    return [], len(text)


def quoted(s: str) -> str | None:
    m = re.search(r"[\"'`]([^\"'`]*)[\"'`]", s)
    return m[1] if m else None


def handler(s: str) -> str | None:
    """Last identifier of a handler expression; null for an inline function."""
    if re.search(r"=>|\bfunction\b|\{", s):
        return None
    names = re.findall(r"[A-Za-z_$][\w$]*", s)
    return names[-1] if names else None


def joined(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def _line(text: str, pos: int) -> int:
    return text.count("\n", 0, pos) + 1


def _script(text: str) -> Iterator[Found]:
    for m in re.finditer(rf"\b(?:app|router|server|\w*[rR]outer)\.({VERBS})\s*\(", text):
        args, _ = arguments(text, m.end() - 1)
        path = quoted(args[0]) if args and args[0][:1] in "\"'`" else None
        if path is None or (m[1] == "use" and not path.startswith("/")):
            continue
        yield "route", f"{m[1].upper()} {path}", _line(text, m.start()), handler(args[-1]) if len(args) > 1 else None
    base, owner = "", None
    for m in re.finditer(r"@(Controller|Get|Post|Put|Patch|Delete|All)\s*\(([^)]*)\)|\bclass\s+(\w+)|^\s+(?:async\s+)?(\w+)\s*\([^)]*\)\s*[:{]", text, re.M):
        if m[1] == "Controller":
            base = quoted(m[2] or "") or ""
        elif m[1]:
            nxt = re.compile(r"(?:\s*@\w+\s*\([^)]*\))*\s*(?:public\s+|async\s+)*(\w+)\s*\(").match(text, m.end())
            name = nxt[1] if nxt else None
            yield "route", f"{m[1].upper()} {joined(base, quoted(m[2] or '') or '')}", _line(text, m.start()), f"{owner}::{name}" if owner and name else name
        elif m[3]:
            owner = m[3]
    # Decorated classes are named after their decorator; a second pass would only matter for two controllers in one file.
    for m in re.finditer(r"<Route\b[^>]*?\bpath\s*=\s*[\"{']+([^\"'}]+)[^>]*?\b(?:element|component)\s*=\s*\{\s*<?\s*(\w+)", text):
        yield "route", f"GET {m[1]}", _line(text, m.start()), m[2]
    for m in re.finditer(r"\bTurboModuleRegistry\.\w+(?:<[^>]*>)?\(\s*['\"](\w+)|\brequireNativeModule\(\s*['\"](\w+)", text):
        yield "component", m[1] or m[2], _line(text, m.start()), None
    for m in re.finditer(r"\brouter\.(?:pushUrl|replaceUrl)\s*\(\s*\{[^}]*\burl\s*:\s*['\"]([^'\"]+)", text):
        yield "route", f"GET {m[1]}", _line(text, m.start()), m[1].rsplit("/", 1)[-1]


def _python(text: str) -> Iterator[Found]:
    for m in re.finditer(r"\b(?:path|re_path|url)\s*\(", text):
        args, _ = arguments(text, m.end() - 1)
        if len(args) > 1 and (p := quoted(args[0])) is not None and args[0][:1] in "rR\"'":
            yield "route", f"ANY {joined(p)}", _line(text, m.start()), handler(re.sub(r"\.as_view\(.*$", "", args[1]))
    for m in re.finditer(r"\.register\s*\(\s*r?[\"']([^\"']*)[\"']\s*,\s*(\w+)", text):
        yield "route", f"VIEWSET {joined(m[1])}", _line(text, m.start()), m[2]
    for m in re.finditer(r"@\w+\.(get|post|put|patch|delete|route|websocket)\s*\(\s*[rf]?[\"']([^\"']*)[\"'][^\n]*\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)", text):
        yield "route", f"{'ANY' if m[1] == 'route' else m[1].upper()} {m[2] or '/'}", _line(text, m.start()), m[3]


def _ruby(text: str) -> Iterator[Found]:
    for m in re.finditer(r"(?m)^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"](?:\s*(?:,\s*to:|=>)\s*['\"]([\w/]+)#(\w+))?", text):
        yield "route", f"{m[1].upper()} {joined(m[2])}", _line(text, m.start()), m[4]
    for m in re.finditer(r"(?m)^\s*resources\s+:(\w+)", text):
        for verb, tail, action in REST_ACTIONS:
            yield "route", f"{verb} {joined(m[1])}{tail}", _line(text, m.start()), action


def _php(text: str) -> Iterator[Found]:
    for m in re.finditer(r"\bRoute::(get|post|put|patch|delete|any|resource)\s*\(", text):
        args, _ = arguments(text, m.end() - 1)
        p = quoted(args[0]) if args else None
        if p is None:
            continue
        target = re.findall(r"['\"@](\w+)['\"]?\s*\]?$", args[1]) if len(args) > 1 else []
        if m[1] == "resource":
            for verb, tail, action in REST_ACTIONS:
                yield "route", f"{verb} {joined(p)}{tail.replace(':id', '{id}')}", _line(text, m.start()), action
        else:
            yield "route", f"{m[1].upper()} {joined(p)}", _line(text, m.start()), target[-1] if target else None


def _java(text: str) -> Iterator[Found]:
    head = re.search(r"@RequestMapping\s*\(([^)]*)\)[^{;]*?\bclass\s+(\w+)", text, re.S)
    base = (quoted(head[1]) or "") if head else ""
    for m in re.finditer(r"@(Get|Post|Put|Patch|Delete|Request)Mapping(?:\s*\(([^)]*)\))?\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:public|private|protected)\s+[\w<>\[\], .?]+\s+(\w+)\s*\(", text):
        verb = m[1].upper()
        if verb == "REQUEST":
            v = re.search(r"RequestMethod\.(\w+)", m[2] or "")
            verb = v[1] if v else "ANY"
        yield "route", f"{verb} {joined(base, quoted(m[2] or '') or '')}", _line(text, m.start()), m[3]


def _csharp(text: str) -> Iterator[Found]:
    head = re.search(r"\[Route\(\s*\"([^\"]*)\"\s*\)\][^{;]*?\bclass\s+(\w+)", text, re.S)
    base = head[1].replace("[controller]", head[2].removesuffix("Controller").lower()) if head else ""
    for m in re.finditer(r"\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*\"([^\"]*)\"[^)]*\))?\]\s*(?:\[[^\]]*\]\s*)*public\s+[\w<>\[\], .?]+\s+(\w+)\s*\(", text):
        yield "route", f"{m[1].upper()} {joined(base, m[2] or '')}", _line(text, m.start()), m[3]
    for m in re.finditer(r"\.Map(Get|Post|Put|Patch|Delete)\s*\(", text):
        args, _ = arguments(text, m.end() - 1)
        if args and (p := quoted(args[0])) is not None:
            yield "route", f"{m[1].upper()} {joined(p)}", _line(text, m.start()), handler(args[1]) if len(args) > 1 else None


def _go(text: str) -> Iterator[Found]:
    for m in re.finditer(r"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|Any|Handle|HandleFunc)\s*\(", text):
        args, _ = arguments(text, m.end() - 1)
        p = quoted(args[0]) if args and args[0][:1] == '"' else None
        if p is not None and len(args) > 1 and p.startswith("/"):
            verb = "ANY" if m[1] in ("Any", "Handle", "HandleFunc") else m[1].upper()
            yield "route", f"{verb} {p}", _line(text, m.start()), handler(args[-1])
    for m in re.finditer(r"g\.Meta\s+`[^`]*\bpath:\"([^\"]+)\"[^`]*\bmethod:\"(\w+)\"", text):
        yield "route", f"{m[2].upper()} {m[1]}", _line(text, m.start()), None


def _rust(text: str) -> Iterator[Found]:
    for m in re.finditer(r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", text):
        yield "route", f"{m[1].upper()} {m[2]}", _line(text, m.start()), m[3]
    for m in re.finditer(r"\.route\s*\(", text):
        args, _ = arguments(text, m.end() - 1)
        p = quoted(args[0]) if len(args) > 1 else None
        if p is not None:
            for verb, name in re.findall(r"\b(get|post|put|patch|delete)\s*\(\s*(?:\)\s*\.to\(\s*)?([A-Za-z_][\w:]*)", args[1]):
                yield "route", f"{verb.upper()} {p}", _line(text, m.start()), name.rsplit("::", 1)[-1]


def _swift(text: str) -> Iterator[Found]:
    groups = {m[1]: (m[2], [quoted(a) or "" for a in arguments(text, m.end() - 1)[0]]) for m in re.finditer(r"\blet\s+(\w+)\s*=\s*(\w+)\.grouped\s*\(", text)}
    for m in re.finditer(r"\b(\w+)\.(get|post|put|patch|delete)\s*\(", text):
        args, _ = arguments(text, m.end() - 1)
        parts = [quoted(a) for a in args if a[:1] == '"']
        use = next((a for a in args if a.startswith("use:")), None)
        if parts or use:
            base, at = [], m[1]
            while at in groups:
                base = groups[at][1] + base
                at = groups[at][0]
            yield "route", f"{m[2].upper()} {joined(*base, *[p or '' for p in parts])}", _line(text, m.start()), handler(use[4:]) if use else None
    for m in re.finditer(r"\bstruct\s+(\w+)\s*:\s*(?:\w+\s*,\s*)*View\b", text):
        yield "component", m[1], _line(text, m.start()), None


def _play(text: str) -> Iterator[Found]:
    for m in re.finditer(r"(?m)^\s*(GET|POST|PUT|PATCH|DELETE)\s+(\S+)\s+([\w.]+)", text):
        yield "route", f"{m[1]} {m[2]}", _line(text, m.start()), "::".join(m[3].split(".")[-2:])


def _objective_c(text: str) -> Iterator[Found]:
    module = re.search(r"\bRCT_EXPORT_MODULE\(\s*(\w*)\s*\)", text)
    name = (module[1] if module else "") or (re.search(r"@implementation\s+(\w+)", text) or ["", ""])[1]
    for m in re.finditer(r"\bRCT_EXPORT_METHOD\(\s*(\w+)", text):
        yield "method", m[1], _line(text, m.start()), f"{name}::{m[1]}"


BY_LANGUAGE = {
    "typescript": (_script,), "javascript": (_script,), "arkts": (_script,), "python": (_python,), "ruby": (_ruby,), "php": (_php,), "java": (_java,), "kotlin": (_java,),
    "csharp": (_csharp,), "go": (_go,), "rust": (_rust,), "swift": (_swift,), "objective_c": (_objective_c,),
}
#: Directories whose files are pages, by framework.
PAGES = re.compile(r"(?:^|/)(?:src/)?(?:pages|routes|app)/(.*?)(?:/\+page|/page|/index)?\.(?:svelte|vue|astro|tsx|jsx)$")


def page_route(path: str) -> str | None:
    """Route of a page file: [x] becomes :x, [...x] becomes *x."""
    m = PAGES.search(path)
    if not m or m[1].startswith("api/") or m[1] in ("_app", "_document"):
        return None
    parts = [re.sub(r"^\[\.\.\.(\w+)\]$", r"*\1", p) for p in m[1].split("/") if not p.startswith("(")]
    parts = [re.sub(r"^\[(\w+)\]$", r":\1", p) for p in parts]
    return joined(*[p for p in parts if p not in ("index", "+page", "page")])


def routes_in(path: str, language: str | None, text: str) -> list[Found]:
    found: list[Found] = []
    for rule in BY_LANGUAGE.get(language or "", ()):
        found += rule(text)
    if re.search(r"(^|/)conf/routes$", path):
        found += _play(text)
    if language == "razor" and (m := re.search(r"@page\s+\"([^\"]+)\"", text)):
        found.append(("route", f"GET {m[1]}", _line(text, m.start()), None))
    if language in ("svelte", "vue", "astro", "typescript", "javascript") and (r := page_route(path)) is not None:
        found.append(("route", f"GET {r}", 1, None))
    return found
