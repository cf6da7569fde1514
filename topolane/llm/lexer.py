"""Tokens of ten languages as strings of kinds, one letter each.

Words and operators have a letter of their own, other tokens one of those below. Brackets stand for themselves; `>` and `<`
open and close a level of indentation. Lexical errors (an open string or comment, a character of no token) raise `Lexed`.
"""

from __future__ import annotations

import re

#: Language by extension.
LANGUAGES = {
    "py": "python", "pyw": "python", "rs": "rust", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript",
    "mjs": "javascript", "cjs": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "xml": "xml", "yaml": "yaml", "yml": "yaml", "properties": "properties",
}

#: Reserved words.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool",
    "javascript": "as async from get of set static await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield true false null",
}
#: Words that are reserved only in some places; elsewhere they are names.
SOFT = {
    "javascript": "as async from get of set static".split(),
    "typescript": "as async from get of set static abstract asserts declare enum implements infer interface is keyof module namespace override private protected public readonly satisfies type unique".split(),
    "python": ["case", "match"],
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " " + " ".join(w for w in SOFT["typescript"] if w not in SOFT["javascript"])
KEYWORDS["python"] += " case match"
OPERATORS = {
    "python": "**= //= >>= <<= ... != == <= >= -> := += -= *= /= %= &= |= ^= @= ** // << >> + - * / % @ & | ^ ~ < > = . , : ;",
    "rust": "<<= >>= ..= ... :: -> => == != <= >= && || += -= *= /= %= ^= &= |= << >> .. + - * / % ^ ! & | < > = @ . , ; : # $ ?",
    "go": "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! , ; . : ~",
    "java": ">>>= <<= >>= >>> ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << >> + - * / % & | ^ ! ~ < > = ? : ; , . @",
    "c": "<<= >>= ... -> ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << >> + - * / % & | ^ ! ~ < > = ? : ; , .",
    "javascript": ">>>= **= <<= >>= >>> === !== &&= ||= ??= ... => ** ++ -- && || ?? ?. == != <= >= += -= *= /= %= &= |= ^= << >> + - * / % & | ^ ! ~ < > = ? : ; , . @ #",
}
OPERATORS["typescript"] = OPERATORS["javascript"]

_WORDS = sorted({w for k in KEYWORDS.values() for w in k.split()} | {o for k in OPERATORS.values() for o in k.split()})
#: Kind of every reserved word and operator; brackets stand for themselves, and the kinds below are those of other tokens.
CODE = {w: chr(0xE000 + i) for i, w in enumerate(_WORDS)}
IDENT, NUMBER, STRING, CHAR, DIRECTIVE, LIFETIME, REGEX, LINE, START, END = "i", "n", "s", "c", "d", "l", "r", "N", "^", "$"
#: Reduced groups: parentheses, square brackets, braces, indented block.
PAREN, SQUARE, BRACE, BLOCK = "P", "B", "C", "S"
#: Levels of indentation open and close like brackets.
OPEN, CLOSE, GROUPS = "([{>", ")]}<", dict(zip("([{>", "PBCS"))

STRINGS = {
    "python": r"(?:[rRbBuU]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\r\n]|\\\r?\n|\\.)*\"|'(?:[^'\\\r\n]|\\\r?\n|\\.)*')",
    "rust": r"(?:br|cr|r)(?P<h>#*)\"(?:.*?)\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*\"",
    "go": r"`[^`]*`|\"(?:[^\"\\\r\n]|\\.)*\"",
    "java": r"\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"",
    "c": r"(?:u8|[uUL])?\"(?:[^\"\\\r\n]|\\\r?\n|\\.)*\"",
    "javascript": r"\"(?:[^\"\\\r\n]|\\\r?\n|\\.)*\"|'(?:[^'\\\r\n]|\\\r?\n|\\.)*'",
}
STRINGS["typescript"] = STRINGS["javascript"]
CHARS = {
    "rust": r"b?'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|.))'",
    "go": r"'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'",
    "java": r"'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'",
    "c": r"(?:u8|[uUL])?'(?:[^'\\\r\n]|\\.)+'",
}
NUMBERS = {
    "python": r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+\-]?[0-9_]+)?[jJ]?)",
    "rust": r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+\-]?[0-9_]+)?)(?:[iuf](?:8|16|32|64|128|size))?",
    "go": r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+\-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+\-]?[0-9_]+)?)i?",
    "java": r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+\-]?\d+)?|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+\-]?[0-9_]+)?)[lLfFdD]?",
    "c": r"(?:0[xX][0-9a-fA-F.]+(?:[pP][+\-]?\d+)?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?)[uUlLfFzZ]*",
    "javascript": r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+\-]?[0-9_]+)?)n?",
}
NUMBERS["typescript"] = NUMBERS["javascript"]
COMMENTS = {"python": r"#[^\r\n]*", "c": r"//(?:[^\r\n\\]|\\\r?\n|\\.)*|/\*.*?\*/"}
for _l in ("go", "java", "javascript", "typescript"):
    COMMENTS[_l] = r"//[^\r\n]*|/\*.*?\*/"
COMMENTS["rust"] = r"//[^\r\n]*"
IDENTS = {l: r"[^\W\d]\w*" for l in KEYWORDS} | {"javascript": r"#?[^\W\d]\w*|#?\$[\w$]*", "typescript": r"#?[^\W\d]\w*|#?\$[\w$]*", "rust": r"(?:r#)?[^\W\d]\w*"}
IDENTS["javascript"] = IDENTS["typescript"] = r"#?(?:[^\W\d]|\$)[\w$]*"


REGEX_LITERAL = re.compile(r"/(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*")
#: What follows `match` or `case` where it heads a block.
MATCH_LINE = re.compile(r"[ \t]+(?!(?:in|is|and|or|if|not|else|for)\b)(?=[\w\"'(\[{\-*~])(?:[^\r\n#\"']|\"[^\"\r\n]*\"|'[^'\r\n]*')*?(?::|[(\[{,][ \t]*(?=[\r\n#]))")


#: Stretches of a formatted string outside and inside of its fields.
FORMAT_TEXT = {q: re.compile(rf"(?:[^\\{{}}\n{q}]|\\(?:\r\n|N\{{[^}}]*\}}|[^{{}}])|\\(?=[{{}}]))*+", re.S) for q in "'\""}
RAW_TEXT = {q: re.compile(rf"(?:[^\\{{}}\n{q}]|\\[^{{}}])*+", re.S) for q in "'\""}
FIELD = re.compile(r"[^'\"{}\[\]():\n]*+")


#: Words that are reserved only before a name.
ALIAS = re.compile(r"[ \t]+[^\W\d]\w*[ \t]*(?:=(?!=)|\[[^\n=]*\][ \t]*=(?!=))")
UNION = re.compile(r"\s+[^\W\d]\w*\s*[{<w]")


class Lexed(Exception):
    """A lexical error; its text names it."""


class Lexer:
    """Token kinds of one language."""

    held: dict[str, Lexer] = {}

    def __init__(self, lang: str):
        self.lang = lang
        self.js = lang in ("javascript", "typescript")
        self.words = {w: CODE[w] for w in KEYWORDS[lang].split() if lang != "python" or w not in SOFT["python"]}
        ops = "|".join(re.escape(o) for o in OPERATORS[lang].split())
        blank = r"(?:[ \t\f\v\xa0\ufeff]+|\\\r?\n)*" if lang in ("python", "c") else r"[ \t\f\v\xa0\ufeff]*"
        parts = [("comment", COMMENTS[lang]), ("string", STRINGS[lang])]
        if lang == "c":
            parts.append(("directive", r"(?m:^)[ \t]*#(?:[^\r\n\\/]|\\\r?\n|\\.|/(?![/*])|/\*.*?\*/)*"))
        if lang in CHARS:
            parts.append(("char", CHARS[lang]))
        if lang == "rust":
            parts += [("life", r"'[^\W\d]\w*(?!')"), ("deep", r"/\*")]
        if lang == "python":
            parts.insert(1, ("formatted", r"(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|[\"'])"))
        if self.js:
            parts += [("tick", "`"), ("slash", "/")]
        # The commonest first; a string with a prefix is no name, so names give way to a quote that follows.
        parts = [("ident", rf"(?>{IDENTS[lang]})(?![\"'#])"), ("close", r"[)\]}]"), ("nl", r"\r\n|\n|\r"), ("open", r"[(\[{]"), *parts, ("number", NUMBERS[lang]), ("late", IDENTS[lang]), ("op", ops), ("eof", r"\Z"), ("bad", ".")]
        if lang == "c":
            parts.insert(0, next(x for x in parts if x[0] == "directive"))
            parts = [x for i, x in enumerate(parts) if i == 0 or x[0] != "directive"]
        self.token = re.compile(blank + "(?:" + "|".join(f"(?P<{n}>{p})" for n, p in parts) + ")", re.S)
        self.regex_ok = {START, LINE, "(", "[", "{", "}", *(CODE[x] for x in "=,;:!&|?+-*%^~<>" if x in CODE), *(CODE[x] for x in ("=>", "&&", "||", "??", "return", "typeof", "case", "==", "===", "!=", "!==", "in", "of", "...") if x in CODE)}
        self.asi = lang == "go"
        self.string = re.compile(STRINGS[lang], re.S)

    @classmethod
    def get(cls, lang: str) -> Lexer:
        if lang not in cls.held:
            cls.held[lang] = cls(lang)
        return cls.held[lang]

    def template(self, text: str, at: int) -> int:
        """End of a template literal that begins at `at`; its substitutions may nest."""
        i, n = at + 1, len(text)
        while i < n:
            ch = text[i]
            if ch == "\\":
                i += 2
            elif ch == "`":
                return i + 1
            elif text.startswith("${", i):
                i, depth = i + 2, 1
                while i < n and depth:
                    ch = text[i]
                    if ch == "`":
                        i = self.template(text, i)
                        continue
                    if ch in "'\"":
                        m = self.string.match(text, i)
                        if not m:
                            raise Lexed("string")
                        i = m.end()
                        continue
                    depth += (ch == "{") - (ch == "}")
                    i += 1
            else:
                i += 1
        raise Lexed("template")

    def formatted(self, text: str, at: int, start: int) -> int:
        """End of a formatted string whose text begins at `start`; its fields may hold strings with the same quotes."""
        quote = text[start - 3 : start] if start - at >= 4 else text[start - 1]
        raw, i, n, depth = "r" in text[at:start].lower(), start, len(text), 0
        while i < n:
            if depth:
                m = FIELD.match(text, i)
                i = m.end()
                ch = text[i : i + 1]
                if ch in "'\"" and ch:
                    if text.startswith(quote, i) and (len(quote) == 3 or not (s := self.string.match(text, i)) or "}" not in text[s.end() :].split("\n", 1)[0]):
                        raise Lexed("string")
                    a = i
                    while a > start and text[a - 1] in "rRbBfFuU":
                        a -= 1
                    if any(c in "fF" for c in text[a:i]):
                        i = self.formatted(text, a, i + (3 if text.startswith(ch * 3, i) else 1))
                    else:
                        s = self.string.match(text, i)
                        if not s:
                            raise Lexed("string")
                        i = s.end()
                elif ch in "{[(" and ch:
                    depth, i = depth + 1, i + 1
                elif ch in "}])" and ch:
                    depth, i = depth - 1, i + 1
                elif ch == ":" and depth == 1:
                    depth, i = depth, i + 1
                    # A format, which may hold fields of its own, up to the brace.
                    while i < n and text[i] != "}":
                        if text.startswith(quote, i) or text[i] == "\n" and len(quote) == 1:
                            raise Lexed("string")
                        if text[i] == "{":
                            end = text.find("}", i)
                            i = end if end > 0 else n
                        i += 1
                elif ch == "\n" and len(quote) == 1:
                    i += 1
                else:
                    i += 1
                continue
            m = (RAW_TEXT if raw else FORMAT_TEXT)[quote[0]].match(text, i)
            i = m.end()
            if text.startswith(quote, i):
                return i + len(quote)
            ch = text[i : i + 1]
            if ch == "{":
                if text.startswith("{{", i):
                    i += 2
                else:
                    depth, i = 1, i + 1
            elif ch == "\n" and len(quote) == 1:
                raise Lexed("string")
            elif ch == "}" and not text.startswith("}}", i):
                raise Lexed("string")
            else:
                i += 2 if ch == "}" else 1
        raise Lexed("string")

    def rust_comment(self, text: str, at: int) -> int:
        depth, i = 1, at + 2
        while depth:
            a, b = text.find("/*", i), text.find("*/", i)
            if b < 0:
                raise Lexed("comment")
            if 0 <= a < b:
                depth, i = depth + 1, a + 2
            else:
                depth, i = depth - 1, b + 2
        return i

    def kinds(self, text: str) -> str:
        """One kind for each token, with line ends and indentation where they matter; raises Lexed."""
        out: list[str] = []
        add, words, code, js = out.append, self.words, CODE, self.js
        pos, n, depth = 0, len(text), 0
        rust, macro = self.lang == "rust", None  # macro: depth outside of a macro's arguments, whose tokens may be any
        python, indents, fresh = self.lang == "python", [0], True
        if text.startswith("#!") and js:
            pos = len(text.split("\n", 1)[0])
        tokens = self.token.finditer(text, pos)
        while True:
            m = next(tokens, None)
            if m is None:
                break
            kind = m.lastgroup
            if kind == "bad":
                raise Lexed("string" if m["bad"] in ("'", '"', "`") else "character")
            if python and fresh and depth == 0 and kind not in ("nl", "comment", "eof"):
                # Indentation of a logical line.
                width = len(text[m.start() : m.start(kind)].expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    add(">")
                while width < indents[-1]:
                    indents.pop()
                    add("<")
                if width != indents[-1]:
                    raise Lexed("indentation")
                fresh = False
            if macro is not None and kind not in ("open", "close", "nl", "comment", "eof", "deep"):
                continue
            if kind == "ident" or kind == "late":
                word = m[kind]
                if python and word == "type" and depth == 0 and (not out or out[-1] in (LINE, ">", "<")) and ALIAS.match(text, m.end()):
                    continue  # what follows is written like an assignment
                if word == "union" and self.lang == "rust" and UNION.match(text, m.end()):
                    word = "struct"
                if python and word in ("match", "case") and depth == 0 and (not out or out[-1] in (LINE, ">", "<")) and MATCH_LINE.match(text, m.end()):
                    add(CODE[word])
                elif js and out and out[-1] in (code["."], code["?."]):
                    add(IDENT)
                else:
                    add(words.get(word, IDENT))
            elif kind == "op":
                word = m["op"]
                if word == "/" and text.startswith("*", m.end()):
                    raise Lexed("comment")
                add(code[word])
            elif kind == "open":
                if rust and macro is None and out and self.takes_any(out):
                    macro = depth
                depth += 1
                add(m["open"])
            elif kind == "close":
                if depth:
                    depth -= 1
                add(m["close"])
                if macro == depth:
                    macro = None
            elif kind == "nl" or kind == "comment":
                if kind == "nl" or "\n" in m["comment"]:
                    if python:
                        if depth == 0 and not fresh and kind == "nl":
                            add(LINE)
                        fresh = fresh or depth == 0
                    elif js or self.asi:
                        if out and out[-1] != LINE:
                            add(LINE)
            elif kind == "number":
                end = m.end()
                if end < n and (text[end].isalnum() or text[end] == "_"):
                    raise Lexed("number")
                add(NUMBER)
            elif kind == "eof":
                break
            elif kind == "formatted":
                tokens = self.token.finditer(text, self.formatted(text, m.start(kind), m.end()))
                add(STRING)
            elif kind == "tick":
                tokens = self.token.finditer(text, self.template(text, m.end() - 1))
                add(STRING)
            elif kind == "slash":
                if not out or out[-1] in self.regex_ok:
                    r = REGEX_LITERAL.match(text, m.end() - 1)
                    if not r:
                        raise Lexed("regex")
                    add(REGEX)
                    tokens = self.token.finditer(text, r.end())
                elif text.startswith("*", m.end()):
                    raise Lexed("comment")
                elif text.startswith("=", m.end()):
                    add(code["/="])
                    tokens = self.token.finditer(text, m.end() + 1)
                else:
                    add(code["/"])
            elif kind == "deep":
                tokens = self.token.finditer(text, self.rust_comment(text, m.end() - 2))
            else:
                add(STRING if kind == "string" or kind == "h" else CHAR if kind == "char" else LIFETIME if kind == "life" else DIRECTIVE)
        if python:
            if out and not fresh:
                add(LINE)
            out += "<" * (len(indents) - 1)
        return "".join(self.lines_in(out) if (js or self.asi) else out)

    @staticmethod
    def takes_any(out: list[str]) -> bool:
        """Whether the bracket after `out` opens the arguments of a macro or an attribute."""
        last, no, sharp = out[-3:], CODE["!"], CODE["#"]
        return last[-1] == sharp or last[-1] == no and last[-2:-1] in ([IDENT], [sharp]) or last[-1] == IDENT and last[-2:-1] == [no] and last[:-2] == [IDENT]

    def lines_in(self, kinds: list[str]) -> list[str]:
        """Keep line ends only where they can end a statement."""
        out: list[str] = []
        stack: list[str] = []
        goes_on = {CODE[x] for x in OPERATORS[self.lang].split() if x not in ("++", "--", ";", "@", "#", "!", "~", "...")} | {"(", "[", "{"}
        goes_on |= {CODE[x] for x in ("const", "let", "var", "new", "typeof", "delete", "in", "instanceof", "extends", "case")}
        if self.asi:
            ends = {IDENT, NUMBER, STRING, CHAR, ")", "]", "}", *(CODE[x] for x in ("break", "continue", "fallthrough", "return", "++", "--"))}
            for k in kinds:
                if k == LINE and not (out and out[-1] in ends):
                    continue
                out.append(k)
            return out
        joins = {CODE[x] for x in OPERATORS[self.lang].split() if x not in ("++", "--", "!", "~", ";", "@", "#", "...", "/")} | {")", "]", "}"}
        for i, k in enumerate(kinds):
            if k in "([{":
                stack.append(k)
            elif k in ")]}" and stack:
                stack.pop()
            if k == LINE:
                after = kinds[i + 1] if i + 1 < len(kinds) else END
                if (stack and stack[-1] in "([") or not out or out[-1] in goes_on or after in joins:
                    continue
            out.append(k)
        return out


_NAME = r"[^\W\d][\w:.\-\u00b7]*"
XML_TOKEN = re.compile(
    rf"""(?P<text>[^<]++)|(?P<close></(?P<cn>{_NAME})\s*>)|(?P<open><(?P<on>{_NAME})(?P<attrs>(?:\s++{_NAME}\s*=\s*(?:"[^<"]*+"|'[^<']*+'))*+)\s*+(?P<self>/)?>)
    |(?P<comment><!--(?:[^\-]|-(?!-))*+-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)|(?P<pi><\?{_NAME}(?:\s.*?)?\?>)|(?P<doctype><!DOCTYPE\s(?:[^\[\]>"']|"[^"]*+"|'[^']*+'|\[(?:[^\]"'<]|"[^"]*+"|'[^']*+'|<!--.*?-->|<)*+\])*+>)""",
    re.S | re.X,
)
XML_AMP = re.compile(r"&(?!(?:[^\W\d][\w.\-]*+|\#[0-9]+|\#x[0-9a-fA-F]+);)")
XML_ENTITY = re.compile(r"&([^\W\d#][\w.\-]*+);")
XML_ATTR = re.compile(rf"({_NAME})\s*=\s*(?:\"[^\"]*\"|'[^']*')")
KNOWN = {"lt", "gt", "amp", "quot", "apos"}
#: Letters for the names of tags, numbered in each file.
NAME_BASE = 0x10000


def xml_kinds(text: str) -> str:
    """'(' and ')' for tags, each before the letter of its name; 'e' an empty tag, 't' text that is not blank, 's' a CDATA
    section, 'p' a declaration, 'o' a document type, 'm' comments and the rest."""
    out, names, pos = [], {}, 0
    text = text.lstrip("\ufeff")
    defined = "<!ENTITY" in text
    while pos < len(text):
        m = XML_TOKEN.match(text, pos)
        if not m:
            raise Lexed("markup")
        kind = "close" if m["close"] else "open" if m["open"] else m.lastgroup
        if kind in ("text", "open") and "&" in m[0]:
            if XML_AMP.search(m[0]) or not defined and any(e not in KNOWN for e in XML_ENTITY.findall(m[0])):
                raise Lexed("entity")
        if kind == "text":
            if "]]>" in m[0]:
                raise Lexed("markup")
            if m[0].strip(" \t\r\n"):
                out.append("t")
        elif kind == "open":
            attrs = [a for a in XML_ATTR.findall(m["attrs"])] if m["attrs"] else []
            if len(attrs) != len(set(attrs)):
                raise Lexed("attribute")
            out.append("e" if m["self"] else "(" + chr(NAME_BASE + names.setdefault(m["on"], len(names))))
        elif kind == "close":
            out.append(")" + chr(NAME_BASE + names.setdefault(m["cn"], len(names))))
        elif kind == "pi":
            if m[0][2:5].lower() == "xml" and not (m[0][5].isalnum() or m[0][5] in "-_.:"):
                if pos or not re.match(r"<\?xml\s+version\s*=", m[0]):
                    raise Lexed("declaration")
                out.append("p")
            else:
                out.append("m")
        else:
            out.append("s" if kind == "cdata" else "o" if kind == "doctype" else "m")
        pos = m.end()
    return "".join(out)


YAML_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+'", re.S)
YAML_KEY = re.compile(r"(?:[&!]\S*\s+)*(?:\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+'|\*\S+ |(?![\-?:](?:\s|$))[^\s#\[\]{},&*!|>'\"%@`](?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![ \t#]))*?)\s*:(?=\s|$)")
YAML_BLOCK = re.compile(r"(?:[&!]\S+\s+)*[|>][+\-0-9]*\s*(?:#.*)?$")
YAML_PROPERTY = re.compile(r"(?:[&!]\S*(?:\s+|$))+")
YAML_ESCAPE = re.compile(r"\\(?![0abtnvfre \"/\\N_LPxuU\n\t])")
YAML_FLOW = re.compile(r"(?P<open>[\[{])|(?P<close>[\]}])|(?P<comma>,)|(?P<colon>:(?=[\s,\[\]{}]|$))|(?P<q>\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+')|(?P<blank>\s+(?:#[^\n]*)?)|(?P<plain>(?:[^\s,\[\]{}:\"'#]|:(?![\s,\[\]{}]|$)|(?<=\w)[\"'#])(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<=\S)#|[ \t]+(?=[^\s,\[\]{}:#]))*+)")


def _flow(text: str) -> tuple[str, str] | None:
    """(kinds, what follows) of a flow collection at the start of `text`, None if it goes on after it."""
    out, i, depth, held = [], 0, 0, False
    while i < len(text):
        m = YAML_FLOW.match(text, i)
        if not m:
            if text[i] in "\"'":
                return None
            raise Lexed("flow")
        i, kind = m.end(), m.lastgroup
        if kind == "open":
            depth += 1
            out.append(m[0])
        elif kind == "close":
            depth -= 1
            out.append(m[0])
            if depth == 0:
                return "".join(out), text[i:]
        elif kind in ("comma", "colon"):
            out.append(m[0])
        elif kind != "blank":
            if kind == "q" and i < len(text) and text[i] == ":":  # a quoted key needs no blank after its colon
                out.append("v:")
                i += 1
            elif not (held and out and out[-1] == "v"):
                out.append("v")
            held = kind == "plain"  # a plain scalar may go on in the next line
            continue
        held = held and kind == "blank"
    return None


def yaml_kinds(text: str) -> str:
    """'k' key with its colon, 'e' entry, 'q' and 'w' explicit key and value, 'v' and 'b' scalars, 'N' line end, '>' and '<'
    levels of columns, 'D' document marker; flow collections as brackets with ',' and ':'."""
    lines = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[str] = []
    cols: list[int] = []
    i, plain, fresh = 0, False, True  # plain: the last value is a plain scalar, which may go on

    def quoted(value: str, base: int) -> str:
        """What follows the quoted scalar at the start of `value`, over as many lines as it takes."""
        nonlocal i
        parts = [value]
        closing = re.compile(r'(?:[^"\\]|\\.)*+"' if value[0] == '"' else r"(?:[^']|'')*+'", re.S)
        m = closing.match(value, 1)
        while not m:
            # A line without the quote cannot end it; one look at the whole for each line that can.
            while True:
                if i >= len(lines) or lines[i].strip() and len(lines[i]) - len(lines[i].lstrip(" ")) <= base:
                    raise Lexed("string")
                parts.append(lines[i])
                i += 1
                if value[0] in parts[-1]:
                    break
            m = closing.match("\n".join(parts), 1)
        whole = "\n".join(parts)
        if value[0] == '"' and YAML_ESCAPE.search(whole[: m.end()]):
            raise Lexed("escape")
        return whole[m.end() :]

    while i < len(lines):
        line = lines[i]
        i += 1
        body = line.lstrip(" ")
        if not body.strip() or body.lstrip("\t").startswith("#"):
            continue
        col = len(line) - len(body)
        if col == 0 and line[:3] in ("---", "...") and (len(line) == 3 or line[3] in " \t"):
            out += ("N" if out and out[-1] == "v" else "") + "<" * len(cols) + "D"
            cols, plain, fresh = [], False, False
            body = line[3:].strip()
            if not body or body.startswith("#"):
                continue
            col = 4
        elif line[0] == "%" and (not out or out[-1] == "D"):
            continue
        elif plain:
            # A scalar is indented deeper than what holds it.
            base = cols[-1] if out[-2:] != [">", "v"] else cols[-2] if len(cols) > 1 else -1
            if col > base:
                if YAML_KEY.match(body):
                    raise Lexed("scalar")
                continue
        if out and out[-1] == "v":
            out.append("N")
        plain = False
        if body[0] == "\t":
            raise Lexed("tab")
        while cols and cols[-1] > col:
            cols.pop()
            out.append("<")
        if not cols or cols[-1] < col:
            cols.append(col)
            out.append(">")
        deeper = False
        while True:
            m = re.match(r"([\-?:])(?:[ \t]+|$)", body)
            key = None if m else YAML_KEY.match(body)
            if not m and not key:
                break
            if deeper:
                cols.append(col)
                out.append(">")
            if m:
                out.append({"-": "e", "?": "q", ":": "w"}[m[1]])
                col, body, deeper = col + m.end(), body[m.end() :], True
                if not body or body.startswith("#"):
                    break
            else:
                out.append("k")
                body = body[key.end() :].strip()
                if re.match(r"-(?:\s|$)", body):
                    raise Lexed("entry")
                break
        base = cols[-1]
        if out[-1] == ">":
            base = cols[-2] if len(cols) > 1 else -1
        if body and YAML_BLOCK.match(body):
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > base):
                i += 1
            out += "bN"
            continue
        body = YAML_PROPERTY.sub("", body, count=1) if body[:1] in ("&", "!") else body
        if not body or body.startswith("#"):
            out.append("N")
        elif body[0] in "\"'":
            rest = quoted(body, base).strip()
            if rest and not rest.startswith("#"):
                raise Lexed("string")
            out += "bN"
        elif body[0] in "[{":
            parts, got, opened = [body], _flow(body), 0
            while got is None:
                # Enough lines for the brackets to close, then one look at the whole.
                opened = sum(p.count("[") + p.count("{") - p.count("]") - p.count("}") for p in parts)
                while True:
                    if i >= len(lines) or lines[i].strip() and len(lines[i]) - len(lines[i].lstrip(" ")) <= base and lines[i].lstrip()[0] not in "]}":
                        raise Lexed("flow")
                    parts.append(lines[i])
                    opened += sum(lines[i].count(c) for c in "[{") - sum(lines[i].count(c) for c in "]}")
                    i += 1
                    if opened <= 0 or "]" in parts[-1] or "}" in parts[-1]:
                        break
                if opened <= 0 or any(c in p for p in parts for c in "\"'#"):
                    got = _flow("\n".join(parts))
            rest = got[1].strip()
            if rest and not rest.startswith("#"):
                raise Lexed("flow")
            out += [got[0], "N"]
        elif body[0] in "%@`,]}|>&" or body[0] == "*" and not re.match(r"\*\S+\s*(?:#.*)?$", body):
            raise Lexed("scalar")
        else:
            said = re.split(r"\s#", body, maxsplit=1)[0]
            if out[-1] == "k" and body[0] != "*" and re.search(r":(?:\s|$)", said):
                raise Lexed("scalar")
            out.append("v")
            plain = body[0] != "*" and len(said) == len(body)
    if out and out[-1] == "v":
        out.append("N")
    return "".join(out) + "<" * len(cols)


def lex(lang: str, text: str) -> tuple[str, str | None]:
    """(kinds, lexical error or None)."""
    try:
        if lang == "xml":
            return xml_kinds(text), None
        return (yaml_kinds(text) if lang == "yaml" else Lexer.get(lang).kinds(text)), None
    except Lexed as e:
        return "", str(e)
