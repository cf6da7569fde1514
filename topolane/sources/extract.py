"""Symbols and pending relations of one source file, and the same for a table of files.

Python is parsed; other languages are scanned by a table of patterns over the text with comments and strings blanked, with block ends by
braces, indentation or `end`. That is no grammar: recall is lower than a parser's, and a call is any name before a parenthesis inside
a function. Relations name their target; `resolve` finds it later.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolane.schemas import FRAGMENT, OWNER_KINDS, SCOPE_KINDS, TYPE_KINDS
from topolane.sources.routes import routes_in

SCOPES = set(SCOPE_KINDS)


@dataclass
class Spec:
    """How a language is scanned. Each pattern has the group `n` for a name; `block` tells how a definition ends."""

    defs: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    bases: tuple[tuple[str, str], ...] = ()  # (relation, pattern) inside a type's header; group n may list several names
    block: str = "brace"
    comment: str = r"//[^\n]*|/\*.*?\*/"
    string: str = r'"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'"
    tags: bool = False  # capitalised tags render components
    wide_calls: bool = False  # calls of the file belong to each of its functions
    compiled: list = field(default_factory=list)


_W = r"(?P<n>[A-Za-z_]\w*)"
_HASH = r"#[^\n]*"
_MODS = r"(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|export|default|declare|open|data|inline|suspend|unsafe|extern|readonly|const|pub(?:\([^)]*\))?)"
_CLASSES = (("class", rf"\bclass\s+{_W}"), ("interface", rf"\binterface\s+{_W}"), ("enum", rf"\benum\s+(?:class\s+)?{_W}"), ("struct", rf"\bstruct\s+{_W}"))
_TS = (
    *_CLASSES, ("type_alias", rf"\btype\s+{_W}\s*(?:<[^=]*>)?\s*="), ("function", rf"\bfunction\s*\*?\s*{_W}\s*[(<]"),
    ("function", rf"\b(?:const|let|var)\s+{_W}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_]\w*)\s*(?::[^=\n]+)?=>"),
    ("method", rf"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*{_W}\s*(?:<[^>\n]*>)?\([^()\n]*\)\s*(?::[^{{;\n]+)?\{{"),
)
_TS_BASES = (("extends", r"\bextends\s+(?P<n>[A-Za-z_][\w.]*)"), ("implements", r"\bimplements\s+(?P<n>[A-Za-z_][\w., <>]*)"))
_TS_IMPORTS = (r"\bimport\s+(?:type\s+)?(?P<n>[^'\";]+?)\s+from\b",)
_C = (
    ("struct", rf"\bstruct\s+{_W}\s*(?:final\s*)?[:{{]"), ("struct", rf"\bunion\s+{_W}\s*\{{"), ("enum", rf"\benum\s+(?:class\s+)?{_W}\s*[:{{]"),
    ("type_alias", rf"\btypedef\b[^;{{}}]*?\b{_W}\s*;"), ("function", rf"(?m)^[A-Za-z_][\w\s*&:<>,]*?[\s*&]{_W}\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{"),
)
_CPP = (*_C, ("class", rf"\bclass\s+{_W}\s*(?:final\s*)?[:{{]"), ("module", rf"\bnamespace\s+{_W}\s*\{{"), ("method", rf"\b[A-Za-z_]\w*::{_W}\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{"))
_C_IMPORTS = (r"#\s*include\s*[<\"](?:[^>\"\n]*/)?(?P<n>[^>\"/\n]+)[>\"]",)
_CPP_BASES = (("inherits", r":\s*(?P<n>(?:(?:public|private|protected|virtual)\s+)*[A-Za-z_][\w:<>]*(?:\s*,\s*(?:(?:public|private|protected|virtual)\s+)*[A-Za-z_][\w:<>]*)*)\s*\{"),)
_LIST_BASES = (("inherits", r":\s*(?P<n>[A-Za-z_][\w.<>, ]*?)\s*(?:where\b|\{)"),)

SPECS: dict[str, Spec] = {
    "rust": Spec(
        (
            ("module", rf"\bmod\s+{_W}\s*[;{{]"), ("struct", rf"\bstruct\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("trait", rf"\btrait\s+{_W}"), ("type_alias", rf"\btype\s+{_W}\s*(?:<[^=]*>)?\s*="),
            ("impl", r"\bimpl\b(?:\s*<[^{;]*?>)?\s+(?P<n>[^{;]+?)\s*(?:where[^{]*)?\{"), ("function", rf"\bfn\s+{_W}"), ("constant", rf"\bconst\s+{_W}\s*:"), ("static", rf"\bstatic\s+(?:mut\s+)?{_W}\s*:"), ("macro", rf"\bmacro_rules!\s*{_W}"),
        ),
        imports=(r"\buse\s+(?P<n>[^;]+);",), bases=(("implements", r"\bimpl\b(?:\s*<[^{;]*?>)?\s+(?P<n>[A-Za-z_][\w:]*)(?:<[^{;]*>)?\s+for\b"),), comment=r"//[^\n]*|/\*.*?\*/",
        string=r'r(?P<h>#*)".*?"(?P=h)|"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)'",
    ),
    "typescript": Spec(_TS, _TS_IMPORTS, _TS_BASES, string=r'"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?:(?<=[=(,:] )|(?<=[=(,:]))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", tags=True),
    "go": Spec(
        (("module", rf"(?m)^package\s+{_W}"), ("method", rf"\bfunc\s*\([^)]*\)\s*{_W}\s*[\[(]"), ("function", rf"\bfunc\s+{_W}\s*[\[(]"), ("struct", rf"\btype\s+{_W}\s+struct\b"), ("interface", rf"\btype\s+{_W}\s+interface\b"), ("type_alias", rf"\btype\s+{_W}\s+(?!struct\b|interface\b)[^\s{{]")),
        imports=(r'(?:\bimport\s+|^\s*)(?:[\w.]+\s+)?"(?:[^"\n]*/)?(?P<n>[^"/\n]+)"\s*$',), string=r'"(?:[^"\\\n]|\\.)*"|`[^`]*`' + r"|'(?:[^'\\\n]|\\.)+'",
    ),
    "java": Spec(
        (("module", r"\bpackage\s+(?P<n>[\w.]+)"), ("class", rf"\b(?:class|record)\s+{_W}"), ("interface", rf"\b@?interface\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("method", rf"(?m)^[ \t]+(?:{_MODS}\s+|@\w+(?:\([^)]*\))?\s+)*(?:<[^>]+>\s+)?[A-Za-z_][\w.<>\[\], ?]*\s+{_W}\s*\([^;{{}}]*\)\s*(?:throws[^{{]*)?\{{")),
        imports=(r"\bimport\s+(?:static\s+)?(?P<n>[\w.*]+)\s*;",), bases=(("extends", r"\bextends\s+(?P<n>[A-Za-z_][\w.<>, ]*?)(?=\s+implements|\s*\{)"), ("implements", r"\bimplements\s+(?P<n>[A-Za-z_][\w.<>, ]*)")),
    ),
    "c": Spec(_C, _C_IMPORTS), "cpp": Spec(_CPP, _C_IMPORTS, _CPP_BASES),
    "cuda": Spec((("kernel", rf"__global__\s+[\w\s*]*?{_W}\s*\("), *_CPP), _C_IMPORTS, _CPP_BASES),
    "metal": Spec((("kernel", rf"\b(?:kernel|vertex|fragment)\s+[\w\s*]*?{_W}\s*\("), *_CPP), _C_IMPORTS, _CPP_BASES),
    "csharp": Spec(
        (("module", r"\bnamespace\s+(?P<n>[\w.]+)"), ("class", rf"\b(?:class|record)\s+{_W}"), *_CLASSES[1:], ("method", rf"(?m)^[ \t]+(?:{_MODS}\s+|\[[^\]]*\]\s*)*[A-Za-z_][\w.<>\[\], ?]*\s+{_W}\s*(?:<[^>]+>)?\([^;{{}}]*\)\s*(?:where[^{{]*)?(?:\{{|=>)")),
        imports=(r"\busing\s+(?P<n>[\w.]+)\s*;",), bases=_LIST_BASES,
    ),
    "php": Spec(
        (("module", r"\bnamespace\s+(?P<n>[\w\\]+)"), *_CLASSES[:3], ("trait", rf"\btrait\s+{_W}"), ("function", rf"\bfunction\s+&?{_W}\s*\(")),
        imports=(r"\buse\s+(?P<n>[\w\\]+)\s*[;,]", r"\b(?:include|require)(?:_once)?\s*\(?\s*['\"](?:[^'\"]*/)?(?P<n>[^'\"/]+)['\"]"), bases=(("inherits", r"\bextends\s+(?P<n>[\w\\]+)"), ("inherits", r"\bimplements\s+(?P<n>[\w\\, ]+)")), comment=r"//[^\n]*|#[^\n\[]*|/\*.*?\*/",
    ),
    "ruby": Spec((("module", r"(?m)^\s*module\s+(?P<n>[A-Z][\w:]*)"), ("class", r"(?m)^\s*class\s+(?P<n>[A-Z][\w:]*)"), ("method", r"(?m)^\s*def\s+(?:self\.)?(?P<n>\w+[?!=]?)")), imports=(r"\brequire(?:_relative)?\s*\(?\s*['\"](?:[^'\"]*/)?(?P<n>[^'\"/]+)['\"]",), bases=(("inherits", r"<\s*(?P<n>[A-Z][\w:]*)"),), block="indent", comment=_HASH),
    "swift": Spec((*((k, p) for k, p in _CLASSES if k != "interface"), ("impl", r"\bextension\s+(?P<n>[\w.]+)"), ("interface", rf"\bprotocol\s+{_W}"), ("function", rf"\bfunc\s+{_W}\s*[(<]")), imports=(r"(?m)^\s*import\s+(?P<n>\w+)",), bases=_LIST_BASES),
    "kotlin": Spec((*_CLASSES[:3], ("module", rf"\bobject\s+{_W}"), ("function", rf"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?{_W}\s*\(")), imports=(r"(?m)^\s*import\s+(?P<n>[\w.]+)",), bases=_LIST_BASES),
    "scala": Spec((("class", rf"\bclass\s+{_W}"), ("trait", rf"\btrait\s+{_W}"), ("module", rf"\bobject\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("function", rf"\bdef\s+{_W}"), ("type_alias", rf"\btype\s+{_W}\s*=")), imports=(r"(?m)^\s*import\s+(?P<n>[\w.]+)",), bases=(("inherits", r"\b(?:extends|with)\s+(?P<n>[A-Za-z_]\w*)"),)),
    "dart": Spec((("class", rf"\b(?:class|mixin)\s+{_W}"), ("impl", rf"\bextension\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("function", rf"(?m)^(?:[\w<>?, ]+\s+)?{_W}\s*\([^;{{}}]*\)\s*(?:async\s*)?\{{"), ("method", rf"(?m)^[ \t]+(?:[\w<>?, ]+\s+)?{_W}\s*\([^;{{}}]*\)\s*(?:async\s*)?\{{")), imports=(r"\bimport\s+['\"](?:[^'\"]*/)?(?P<n>[^'\"/]+)['\"]",), bases=(("inherits", r"\b(?:extends|implements|with)\s+(?P<n>[A-Za-z_][\w<>, ]*?)(?=\s+(?:implements|with)|\s*\{)"),)),
    "lua": Spec((("function", r"\bfunction\s+(?P<n>[\w.:]+)\s*\("), ("function", rf"\blocal\s+{_W}\s*=\s*function\b")), imports=(r"\brequire\s*\(?\s*['\"](?:[^'\"]*[./])?(?P<n>[^'\"./]+)['\"]",), block="indent", comment=r"--\[\[.*?\]\]|--[^\n]*"),
    "objective_c": Spec((("interface", rf"@interface\s+{_W}"), ("impl", rf"@implementation\s+{_W}"), ("interface", rf"@protocol\s+{_W}"), ("method", rf"(?m)^[-+]\s*\([^)]*\)\s*{_W}")), imports=(r"#\s*import\s*[<\"](?:[^>\"\n]*/)?(?P<n>[^>\"/\n]+)[>\"]",), bases=(("inherits", r"@interface\s+\w+\s*:\s*(?P<n>\w+)"),)),
    "yaml": Spec((), block="line", comment=_HASH), "properties": Spec((), block="line", comment=r"(?m)^\s*[#!][^\n]*"), "xml": Spec((), block="line", comment=r"<!--.*?-->"), "twig": Spec((("function", r"\{%-?\s*macro\s+(?P<n>\w+)"), ("component", r"\{%-?\s*block\s+(?P<n>\w+)")), block="line", comment=r"\{#.*?#\}"),
    "terraform": Spec((("resource", r'(?m)^\s*resource\s+"(?P<n>[\w-]+"\s+"[\w-]+)"'), ("data", r'(?m)^\s*data\s+"(?P<n>[\w-]+"\s+"[\w-]+)"'), ("module", r'(?m)^\s*module\s+"(?P<n>[\w-]+)"'), ("variable", r'(?m)^\s*variable\s+"(?P<n>[\w-]+)"'), ("output", r'(?m)^\s*output\s+"(?P<n>[\w-]+)"'), ("provider", r'(?m)^\s*provider\s+"(?P<n>[\w-]+)"')), imports=(r'\bsource\s*=\s*"(?P<n>[^"\n]+)"',), comment=r"#[^\n]*|//[^\n]*|/\*.*?\*/", string=r"(?!)"),
    "nix": Spec((("function", rf"(?m)^\s*{_W}\s*=\s*(?:\w+|\{{[^}}]*\}})\s*:"), ("constant", rf"(?m)^\s*{_W}\s*=\s*(?!\w+\s*:|\{{[^}}]*\}}\s*:)")), imports=(r"\b(?:import|callPackage)\s+(?P<n>[./][\w./-]+)",), comment=r"#[^\n]*|/\*.*?\*/", block="line"),
    "r": Spec((("function", r"(?m)^\s*(?P<n>[\w.]+)\s*(?:<-|=)\s*function\s*\("), ("class", r"\bsetClass\s*\(\s*['\"](?P<n>\w+)")), imports=(r"\b(?:library|require)\s*\(\s*['\"]?(?P<n>[\w.]+)",), comment=_HASH, string=r"(?!)", wide_calls=True),
    "erlang": Spec((("module", r"(?m)^-module\(\s*(?P<n>\w+)"), ("function", r"(?m)^(?P<n>[a-z]\w*)\s*\([^)]*\)\s*(?:when[^-]*)?->")), imports=(r"(?m)^-include(?:_lib)?\(\s*\"(?:[^\"]*/)?(?P<n>[^\"/]+)\"", r"(?m)^-behaviou?r\(\s*(?P<n>\w+)"), comment=r"%[^\n]*", string=r"(?!)", block="line", wide_calls=True),
    "solidity": Spec((("class", rf"\b(?:contract|library)\s+{_W}"), ("interface", rf"\binterface\s+{_W}"), ("struct", rf"\bstruct\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("event", rf"\bevent\s+{_W}"), ("function", rf"\b(?:function|modifier)\s+{_W}")), imports=(r"\bimport\s+[^;]*['\"](?:[^'\"]*/)?(?P<n>[^'\"/]+)['\"]",), bases=(("inherits", r"\bis\s+(?P<n>[A-Za-z_][\w, ]*)"),), wide_calls=True),
    "pascal": Spec((("module", r"(?i)\b(?:unit|program)\s+(?P<n>[\w.]+)\s*;"), ("function", r"(?im)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?P<n>[\w.]+)"), ("class", r"(?i)\b(?P<n>\w+)\s*=\s*class\b")), imports=(r"(?i)\buses\s+(?P<n>[^;]+);",), bases=(("inherits", r"(?i)=\s*class\s*\(\s*(?P<n>[\w, ]+)\)"),), comment=r"//[^\n]*|\{[^}]*\}|\(\*.*?\*\)", block="line", wide_calls=True),
    "razor": Spec((("method", rf"\b(?:void|Task|string|int|bool|async)\s+{_W}\s*\([^)]*\)\s*\{{"),), imports=(r"(?m)^\s*@using\s+(?P<n>[\w.]+)",), comment=r"@\*.*?\*@|<!--.*?-->", tags=True),
    "vbnet": Spec((("module", r"(?im)^\s*(?:Namespace|(?:Public\s+)?Module)\s+(?P<n>[\w.]+)"), ("class", r"(?im)^\s*(?:\w+\s+)*Class\s+(?P<n>\w+)"), ("interface", r"(?im)^\s*(?:\w+\s+)*Interface\s+(?P<n>\w+)"), ("struct", r"(?im)^\s*(?:\w+\s+)*Structure\s+(?P<n>\w+)"), ("enum", r"(?im)^\s*(?:\w+\s+)*Enum\s+(?P<n>\w+)"), ("function", r"(?im)^\s*(?:\w+\s+)*(?:Sub|Function)\s+(?P<n>\w+)"), ("reference", r"(?im)^\s*(?:Imports|Inherits|Implements)\s+(?P<n>[\w.]+)")), comment=r"'[^\n]*", string=r'"[^"\n]*"', block="indent", wide_calls=True),
    "cfml": Spec((("function", r"(?i)<cffunction[^>]*\bname\s*=\s*['\"](?P<n>\w+)"), ("function", r"(?i)\bfunction\s+(?P<n>\w+)\s*\("), ("query", r"(?i)<cfquery[^>]*\bname\s*=\s*['\"](?P<n>\w+)")), imports=(r"(?i)<cfinclude[^>]*\btemplate\s*=\s*['\"](?:[^'\"]*/)?(?P<n>[^'\"/]+)",), bases=(("inherits", r"(?i)\bextends\s*=\s*['\"](?P<n>[\w.]+)"),), comment=r"<!---.*?--->|//[^\n]*|/\*.*?\*/", string=r"(?!)", block="line", wide_calls=True),
    "cobol": Spec((("module", r"(?im)^.{0,7}\s*PROGRAM-ID\.\s*(?P<n>[\w-]+)"), ("function", r"(?im)^.{6,7}(?P<n>[A-Z0-9][\w-]*)\s+SECTION\s*\."), ("function", r"(?im)^.{7}(?P<n>[A-Z][\w-]*)\.\s*$")), imports=(r"(?im)\bCOPY\s+['\"]?(?P<n>[\w-]+)",), comment=r"(?m)^.{6}\*[^\n]*", string=r"(?!)", block="line"),
}
SPECS["javascript"] = SPECS["typescript"]
SPECS["luau"] = SPECS["lua"]
SPECS["arkts"] = Spec((("component", rf"\bstruct\s+{_W}"), *_TS), _TS_IMPORTS, _TS_BASES, string=SPECS["typescript"].string, tags=True)
WEB = ("svelte", "vue", "astro", "liquid")
for _w in WEB:
    SPECS[_w] = Spec((), imports=(r"\{%-?\s*(?:include|render)\s+['\"](?P<n>[^'\"]+)['\"]",), block="line", comment=r"<!--.*?-->", string=r"(?!)", tags=True)

NO_CALL = set(
    "if for while switch catch return sizeof function match with await typeof super new and or not elif except lambda print assert raise def class fn fun func sub when unless until loop do else case throw delete yield in is where using lock".split()
)
CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")
TAG = re.compile(r"<([A-Z]\w*)[\s/>]")
HANDLER = re.compile(r"(?:\bon:?[A-Za-z]+|@[a-z]+|v-on:[a-z]+)\s*=\s*[\"'{]+\s*(?:\(\)\s*=>\s*)?([A-Za-z_$][\w$]*)")
SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I)
PLACEHOLDER = re.compile(r"\$\{([^}:]+)[^}]*\}")


class Builder:
    """Nodes and relations of one file; node 0 is the file."""

    def __init__(self, path: str, content: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", content))]
        n = max(1, len(content.splitlines()))
        self.nodes: list[dict] = [dict(local_id=0, kind="file", label=path.rsplit("/", 1)[-1], qualified_name=path, start_line=1, end_line=n, parent_local_id=None)]
        self.pending: list[dict] = []
        self.local: list[dict] = []

    def line(self, pos: int) -> int:
        return bisect.bisect_right(self.starts, pos)

    def node(self, kind: str, label: str, first: int, last: int, parent: int = 0, qualified: str | None = None) -> int:
        self.nodes.append(dict(local_id=len(self.nodes), kind=kind, label=label, qualified_name=qualified or label, start_line=first, end_line=max(first, last), parent_local_id=parent))
        return len(self.nodes) - 1

    def relate(self, source: int, target: str, kind: str, line: int) -> None:
        if target:
            self.pending.append(dict(ord=len(self.pending), source_local_id=source, target_name=target, kind=kind, line=line))

    def nested(self, items: list[tuple[int, int, str, str]]) -> list[int]:
        """Place definitions (first line, last line, kind, name) by containment; returns their ids."""
        stack: list[tuple[int, int, str, str]] = []  # (id, last line, kind, qualified)
        out = []
        for first, last, kind, name in items:
            while stack and stack[-1][1] < first:
                stack.pop()
            above = [s for s in stack if s[2] in SCOPES]
            if kind == "function":
                for s in reversed(above):
                    if s[2] in OWNER_KINDS:
                        break
                    if s[2] in (*TYPE_KINDS, "impl"):
                        kind = "method"
                        break
            shown = f"impl {name}" if kind == "impl" else name
            qualified = "::".join([above[-1][3], shown] if above else [shown])
            i = self.node(kind, shown, first, last, stack[-1][0] if stack else 0, qualified)
            stack.append((i, last, kind, qualified))
            out.append(i)
        return out

    def owner(self, line: int, kinds=OWNER_KINDS) -> int | None:
        best = None
        for n in self.nodes:
            if n["kind"] in kinds and n["start_line"] <= line <= n["end_line"] and (best is None or n["start_line"] >= best["start_line"]):
                best = n
        return None if best is None else best["local_id"]


def names_of(text: str) -> list[str]:
    """Identifiers in an import or base list; for paths the last part of each."""
    text = re.sub(r"\b(?:public|private|protected|virtual|as\s+\w+|type)\b", " ", text)
    out = []
    for part in re.split(r"[,{}\s]+", re.sub(r"<[^<>]*>", "", text)):
        name = re.split(r"[:./\\]+", part.strip("*; "))[-1] if part.strip("*; ") else ""
        if name and name not in ("self", "crate", "super", "use", "*"):
            out.append(name)
    return out


def blank(text: str, spec: Spec, strings: bool = True) -> str:
    """Comments (and strings) as blanks of the same length."""
    keep = re.compile(f"(?P<c>{spec.comment.replace('(?m)', '').replace('(?im)', '')})|(?P<s>{spec.string})", re.S | re.M)
    hide = lambda m: re.sub(r"[^\n]", " ", m[0])
    return keep.sub(lambda m: hide(m) if m["c"] is not None or strings else m[0], text)


def block_end(text: str, pos: int, spec: Spec, b: Builder) -> int:
    """Last line of the definition that begins at `pos`."""
    if spec.block == "line":
        return b.line(pos)
    if spec.block == "indent":
        first = b.line(pos)
        lines = text.split("\n")
        col = len(lines[first - 1]) - len(lines[first - 1].lstrip())
        at = first
        while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > col):
            at += 1
        closes = at < len(lines) and re.match(r"\s*(?:end\b|End\b|\})", lines[at])
        return at + 1 if closes else at
    depth, i, opened = 0, pos, False
    while i < len(text):
        ch = text[i]
        if ch == "{":
            depth, opened = depth + 1, True
        elif ch == "}":
            depth -= 1
            if opened and depth <= 0:
                return b.line(i)
            if depth < 0:
                return b.line(pos)
        elif ch == ";" and not opened:
            return b.line(i)
        i += 1
    return b.line(len(text) - 1) if opened else b.line(pos)


def scan_text(path: str, lang: str, text: str, b: Builder, parent: int = 0) -> None:
    """Definitions, calls, imports and bases of a text by its language's table."""
    spec = SPECS[lang]
    bare, with_strings = blank(text, spec), blank(text, spec, False)
    # Names of quoted definitions (Terraform, CFML, XML) need their strings.
    body = with_strings if spec.string == r"(?!)" else bare
    found: dict[tuple[int, str], tuple] = {}
    for stated, pattern in spec.defs:
        for m in re.finditer(pattern, body, re.S if stated == "impl" else 0):
            kind = stated
            name = re.sub(r'"\s+"', ".", m["n"]).strip()
            if kind in ("method", "function") and name in NO_CALL:
                continue
            if kind == "impl":
                name = re.sub(r"\s+", " ", name)
            if kind == "function" and lang in ("lua", "luau") and re.search(r"[.:]", name):
                kind, name = "method", re.split(r"[.:]", name)[-1]
            first = b.line(m.start("n"))
            if (m.start("n"), name) not in found:
                found[(m.start("n"), name)] = (first, block_end(body, m.end() - (1 if m[0].endswith("{") else 0), spec, b), kind, name)
    items = sorted(found.values(), key=lambda x: (x[0], -x[1]))
    where = b.nested(items)
    if parent and where:
        for i in where:
            if b.nodes[i]["parent_local_id"] == 0:
                b.nodes[i]["parent_local_id"] = parent
    for relation, pattern in spec.bases:
        for m in re.finditer(pattern, body):
            line = b.line(m.start("n"))
            # The type whose header this is: the last one that begins at or before the match.
            heads = [i for i in where if b.nodes[i]["kind"] in (*TYPE_KINDS, "impl") and b.nodes[i]["start_line"] <= line]
            if heads and line - b.nodes[heads[-1]]["start_line"] <= 3:
                for name in names_of(m["n"]):
                    b.relate(heads[-1], name, relation, line)
    for pattern in spec.imports:
        for m in re.finditer(pattern, with_strings, re.M):
            line = b.line(m.start("n"))
            label = " ".join(m[0].split())
            i = b.node("import", label if len(label) <= 72 else label[:71] + "…", line, b.line(m.end() - 1))
            stem = m["n"] + {"ruby": ".rb", "lua": ".lua", "luau": ".lua"}.get(lang, "")
            for name in [stem] if lang in ("c", "cpp", "cuda", "metal", "objective_c", "ruby", "lua", "luau", "php", "erlang") else names_of(m["n"]):
                b.relate(i, name, "imports", line)
    owners = [i for i in where if b.nodes[i]["kind"] in OWNER_KINDS]
    heads = {(b.nodes[i]["start_line"], b.nodes[i]["label"]) for i in where}
    if spec.wide_calls:
        calls = sorted({m[1] for m in CALL.finditer(bare)} - NO_CALL)
        for i in owners:
            for name in calls:
                if name != b.nodes[i]["label"]:
                    b.relate(i, name, "calls", b.nodes[i]["start_line"])
    elif owners:
        # Innermost owner of each line, from the definitions in order.
        inner: dict[int, int] = {}
        for i in owners:
            for line in range(b.nodes[i]["start_line"], b.nodes[i]["end_line"] + 1):
                inner[line] = i
        for m in CALL.finditer(bare):
            line = b.line(m.start())
            if m[1] not in NO_CALL and (line, m[1]) not in heads and line in inner:
                b.relate(inner[line], m[1], "calls", line)
        if spec.tags:
            for m in TAG.finditer(bare):
                if (line := b.line(m.start())) in inner:
                    b.relate(inner[line], m[1], "renders", line)


def scan_python(path: str, text: str, b: Builder) -> None:
    """Exact, by the standard parser; a text that does not parse is scanned by lines."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        found = [(b.line(m.start("n")), block_end(text, m.start("n"), Spec((), block="indent"), b), "class" if m[1] == "class" else "function", m["n"]) for m in re.finditer(r"(?m)^[ \t]*(?:async\s+)?(class|def)\s+(?P<n>\w+)", text)]
        b.nested(sorted(found))
        return

    def walk(node: ast.AST, parent: int, scope: str, owner: int | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                qualified = f"{scope}::{child.name}" if scope else child.name
                i = b.node(kind, child.name, child.lineno, child.end_lineno or child.lineno, parent, qualified)
                for base in getattr(child, "bases", ()):
                    b.relate(i, last_name(base), "extends", child.lineno)
                walk(child, i, qualified, owner if kind == "class" else i, kind == "class")
            else:
                if isinstance(child, ast.Import | ast.ImportFrom):
                    i = b.node("import", ast.unparse(child)[:72], child.lineno, child.end_lineno or child.lineno, parent)
                    b.relate(i, child.names[-1].name.split(".")[-1], "imports", child.lineno)
                elif isinstance(child, ast.Call) and owner is not None:
                    b.relate(owner, last_name(child.func), "calls", child.lineno)
                walk(child, parent, scope, owner, False if owner is not None else in_class)

    walk(tree, 0, "", None, False)


def last_name(node: ast.AST) -> str:
    while isinstance(node, ast.Subscript | ast.Call):
        node = node.value if isinstance(node, ast.Subscript) else node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def scan_keys(lang: str, text: str, b: Builder) -> None:
    """Keys of YAML and properties as constants, with the placeholders in their values; values are never kept."""
    stack: list[tuple[int, str]] = []
    for no, line in enumerate(text.splitlines(), 1):
        if lang == "yaml":
            m = re.match(r"^(\s*)(?:-\s+)?([\w.\-/]+)\s*:(?:\s+(.*))?$", line)
            if not m:
                continue
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            key = ".".join([*(k for _, k in stack), m[2]])
            value = (m[3] or "").strip()
            if not value or value.startswith("#"):
                stack.append((depth, m[2]))
                continue
        else:
            m = re.match(r"^\s*(?![#!])([^\s:=]+)\s*[:=]\s*(.*)$", line)
            if not m:
                continue
            key, value = m[1], m[2]
        i = b.node("constant", key, no, no)
        for name in PLACEHOLDER.findall(value):
            b.relate(i, name.strip(), "references", no)


def scan_xml(text: str, b: Builder) -> None:
    """Mapper files: the namespace as module, statements as queries that bind the method of the same id."""
    head = re.search(r"<mapper\b[^>]*\bnamespace\s*=\s*\"([^\"]+)\"", text)
    if not head:
        return
    top = b.node("module", head[1], b.line(head.start()), b.nodes[0]["end_line"])
    for m in re.finditer(r"<(select|insert|update|delete|sql)\b([^>]*)>(?:.*?</\1>)?", text, re.S):
        ident = re.search(r"\bid\s*=\s*\"([^\"]+)\"", m[2])
        if not ident:
            continue
        line = b.line(m.start())
        i = b.node("query_fragment" if m[1] == "sql" else "query", ident[1], line, b.line(m.end() - 1), top, f"{head[1]}::{ident[1]}")
        if m[1] != "sql":
            b.relate(i, ident[1], "binds", line)
        for name in re.findall(r"\b(?:resultMap|refid)\s*=\s*\"([^\"]+)\"", m[0]):
            b.relate(i, name.rsplit(".", 1)[-1], "references", line)


def scan_twig(path: str, text: str, b: Builder) -> None:
    i = b.node("component", b.nodes[0]["label"].removesuffix(".twig"), 1, b.nodes[0]["end_line"])
    for m in re.finditer(r"\{%-?\s*(include|extends|embed|use|import|from)\s+['\"](?:[^'\"]*/)?([^'\"/]+?)(?:\.html)?\.twig['\"]|\{\{-?\s*([A-Za-z_]\w*)", text):
        line = b.line(m.start())
        b.relate(i, m[2] or m[3], ("imports" if m[1] in ("import", "from") else "renders") if m[1] else "binds", line)


def scan_web(path: str, lang: str, text: str, b: Builder) -> None:
    """A component, the tags it renders, its handlers, and its embedded scripts with their line offset."""
    stem = b.nodes[0]["label"].rsplit(".", 1)[0]
    top = b.node("component", stem, 1, b.nodes[0]["end_line"])
    regions = [(m.start(2), m[2], "typescript" if re.search(r"lang\s*=\s*[\"']ts", m[1]) else "javascript") for m in SCRIPT.finditer(text)]
    if lang == "astro" and (m := re.match(r"---\r?\n(.*?)\r?\n---", text, re.S)):
        regions.append((m.start(1), m[1], "typescript"))
    outside = text
    for start, body, _ in regions:
        outside = outside[:start] + re.sub(r"[^\n]", " ", body) + outside[start + len(body) :]
    for m in TAG.finditer(outside):
        b.relate(top, m[1], "renders", b.line(m.start()))
    for m in HANDLER.finditer(outside):
        b.relate(top, m[1], "binds", b.line(m.start()))
    for start, body, inner in regions:
        # Everything but the region is blanked, so that positions and line numbers stay.
        rest = lambda x: re.sub(r"[^\n]", " ", x)
        scan_text(path, inner, rest(text[:start]) + body + rest(text[start + len(body) :]), b, top)


def extract(path: str, language: str | None, content: str | None) -> tuple[list[dict], list[dict], list[dict]]:
    """(nodes, pending relations, local edges) of a file; a language without a scanner gives the file node alone."""
    text = (content or "").replace("\r\n", "\n")
    b = Builder(path, text)
    if language == "python":
        scan_python(path, text, b)
    elif language in ("yaml", "properties"):
        scan_keys(language, text, b)
    elif language == "xml":
        scan_xml(text, b)
    elif language in WEB:
        scan_web(path, language, text, b)
    elif language in SPECS:
        if language == "twig":
            scan_twig(path, text, b)
        if language == "razor":
            b.node("component", b.nodes[0]["label"].rsplit(".", 1)[0], 1, b.nodes[0]["end_line"])
        scan_text(path, language, text, b)
    for kind, label, line, target in routes_in(path, language, text):
        i = b.node(kind, label, line, line)
        if target:
            b.relate(i, target, "routes_to" if kind == "route" else "exports", line)
    shown = [n["local_id"] for n in b.nodes if n["kind"] == "component"]
    if shown:  # the last component of a file is what its routes show
        for n in b.nodes:
            if n["kind"] == "route":
                b.local.append(dict(ord=len(b.local), source_local_id=n["local_id"], target_local_id=shown[-1], kind="routes_to"))
    return b.nodes, b.pending, b.local


def fragments(files: DataFrame) -> DataFrame:
    """One fragment for each file of (path, language, content, content_hash, …); other columns are kept in front."""
    keep = [c for c in files.columns if c not in ("path", "language", "content", "content_hash")]
    names = [*keep, "path", "language", "content_hash", "nodes", "pending", "local_edges"]
    schema = ", ".join([*[f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep], FRAGMENT])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                nodes, pending, local = extract(r["path"], r["language"], r["content"])
                rows.append([*(r[c] for c in keep), r["path"], r["language"], r["content_hash"], nodes, pending, local])
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(go, schema)


def flat_nodes(frags: DataFrame, keep: list[str]) -> DataFrame:
    return frags.select(*keep, "path", F.explode("nodes").alias("n")).select(*keep, "path", "n.*")


def flat_pending(frags: DataFrame, keep: list[str]) -> DataFrame:
    return frags.select(*keep, "path", F.explode("pending").alias("n")).select(*keep, "path", "n.*")
