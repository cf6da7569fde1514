"""Credentials embedded in source code and tool records: find them and mask them, leaving the code around them as it was.

Every quoted string and every long token is a candidate. It counts if its Shannon entropy, relative to the alphabet it is
written in, is above a threshold adjusted to its length and its kinds of characters change as in generated text
(`generated`). What stands before it (a name, a header, an option, a URL) or the fixed form of a vendor's token only lowers
what is asked; a password in a URL and a private key need no entropy, since their place says what they are. Placeholders,
masked values, references, hashes, ids, public keys and certificates are left out.

Cases: null, empty and unreadable texts have no credential; several on one line give one row; a credential divided into
joined literals, or running over several lines, counts where it begins; texts of any length are read whole; repeated
rows are judged alike; extra columns are carried along.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

#: Forms of tokens that vendors publish.
VENDOR = re.compile(
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[\w\-]{20}|npm_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{32,}|xox[abprs]-[0-9A-Za-z\-]{20,}|AIza[\w\-]{35}|github_pat_\w{22,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|hf_[A-Za-z0-9]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{16,}"
)
VENDOR_START = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|gh[pousr]_|glpat-|npm_|sk-|xox[abprs]-|AIza|github_pat_|[rs]k_(?:live|test)_|hf_|SG\.|eyJ)[\w.\-]*")
JOINED = re.compile(r"""(["'])\s*(?:\+|\\\r?\n|\.\.|\.)?\s*[bru]?(["'])([\w.\-+/=!?$%#*@:]+)""")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BODY = re.compile(r"[A-Za-z0-9+/]{16}")
#: What belongs to a key without a closing line: headers and lines of its body, also as escaped or joined literals.
KEY_REST = re.compile(r"""(?:(?:\\[nr]|[\s"'+,\\])*+(?:[A-Za-z0-9+/=]{16,}+|[A-Z][A-Za-z\-]+: [^\n\\]*+))*+(?:(?:\\[nr]|[\s"'+,\\])*+[A-Za-z0-9+/=]{1,15}(?=["'\\\r\n]|\Z))?""")
URL = re.compile(r"""(?<=[A-Za-z0-9])://([^\s:/@'"`<>]*+):((?:(?!://)[^\s@'"`<>])++)@(?=[\w\[])""")
HEADER = re.compile(r"(?i)\b(bearer|basic|authorization: token)\s+([A-Za-z0-9+/=_.\-~]{8,})")
OPTION = re.compile(r"""(?<=\s)--?(?:password|passwd|pass|passphrase|token|secret|api-key|auth-token|access-token)(?:=|\s+)(["']?)([^\s"']+)\1""")
SHORT_OPTION = re.compile(r"""\s-p\s*(["']?)([^\s"']+)\1""")
#: One command of a line, and the commands whose -p is a password.
COMMAND = re.compile(r"[^\n|;&]++")
LOGIN = re.compile(r"\b(?:login|sshpass|mysql\w*|psql|mongo\w*)\b")
USER_OPTION = re.compile(r"""(?<=\s)(?:-u|--user)(?:=|\s+)(["']?)[^\s:"']+:([^\s"'/]+)\1(?=\s|$)""")
SAID = re.compile(r"""(?i)\b(?:passwords?|passphrase|secret|api key|token|key)\s+(?:is\s+|was\s+)?(["'`]?)([^\s"'`,;]{6,})\1""")
XML_PAIR = re.compile(r"""name\s*=\s*["']([\w.\-]+)["']\s+value\s*=\s*["']([^"'<>]*)["']""")
WORDS = ("pass", "pwd", "secret", "token", "key", "credential")
VENDOR_WORDS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "npm_", "sk-", "xox", "AIza", "github_pat_", "k_live_", "k_test_", "hf_", "SG.", "eyJ")
NAME_END = re.compile(r"[\w.\-]*")
REST = re.compile(
    r"""(["']?\]?)(?:\s*:\s*(?:&(?:'static\s+)?)?(?:(?:str|string|String|any|char)\b|\[u8\])(?:\s*\[\])?)?\s*(?::=|=>|=|:|>|(?=[ \t]+["']))[ \t]*\(?\s*(?:[brfu]|\\)?(?:(["'`])((?:(?!\2)[^\n\\]|\\.)*)\2)"""
)
REST_PLAIN = re.compile(r"""["']?[ \t]*(?::=|=>|=|:|>)[ \t]*((?:[^\s"'`<>,;(){}\[\]\\&]|&(?![\w.\-]+=))+)""")
STRONG_NAME = re.compile(r"(?:password|passwd|passphrase|pwd|^pass$|(?:^|admin|root|user|db|smtp)pass$|secret(?!store|ref|name|manager|path|file)|apikey|accesskey|signingkey|encryptionkey|privatekey|masterkey|credentials?$)")
TOKEN_NAME = re.compile(r"(?:token|authkey|sessionkey)$")
NO_NAME = re.compile(r"(?:field|selector|input|hint|policy|length|len|ttl|expiry|url|uri|path|file|label|prompt|regex|pattern|type|count|hash|digest|store|env|var|ref|stdin|public\w*|enabled|required|prefix|suffix)$")
REFERENCE = re.compile(r"""^(?:\$|%\(|%[A-Z_]+%|\{\{|\{[A-Za-z_]|<|#\{|@\{|vault|secrets?[:./]|arn:|env[:.(]|os\.|process\.|System\.|ssm:|keyring|file:|ref[:+])|\$\{|\{\{""", re.I)
PLACEHOLDER = re.compile(r"(?i)^(?:x{4,}|\*+|\.{3,}|-+|_+|0+|1234\d*|n/?a|none|null|nil|true|false|redacted|masked|hidden|\[.*\]|<.*>|replace.?me|change.?me|changeit|todo|tbd|dummy|sample|test|example|password|passwd|secret|token|pass|user|admin|root|foo|bar|default|your.*|my[_-].*|insert.*|enter.*)$|example|placeholder|not-a-key|your[_-]|redacted|x{6,}|\*{3,}|dummy|fake")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
HASH = re.compile(r"^(?:(?:sha\d*|md5|blake\w*)[-:])|^\$2[aby]\$|^ssh-|^AAAA[BC]3|^-----BEGIN (?:CERT|PUBLIC)")
#: Bits for each character that a random text in the alphabet has.
ALPHABETS = ((re.compile(r"^[0-9]+$"), 3.32), (re.compile(r"^[0-9a-f\-]+$|^[0-9A-F\-]+$"), 4.0), (re.compile(r"^[A-Z2-7=]+$"), 5.0), (re.compile(r"^[A-Za-z0-9+/=_\-]+$"), 6.0), (re.compile(r""), 6.5))

#: Candidates of any context: a literal without white space, a long token, and a token that begins joined literals.
LITERAL = re.compile(r"""(["'`])([^\s"'`<>\\]{16,})(?=\1)""")
LONG = re.compile(r"""[A-Za-z0-9+/_\-.~]{20,}=*|[A-Za-z0-9+/_\-.~]{6,}=*(?=["']\s*(?:\+|\\\r?\n|\.\.|\.)\s*[bru]?["'])""")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
#: What stands before a hash, an id, a public value or embedded data.
NOT_SECRET = re.compile(r"""(?i)(?:hash|sha-?\d*|digest|checksum|integrity|etag|md5|fingerprint|commit|revision|nonce|signature|(?:^|[^a-z])(?:rev|sig|sri|ref)|(?:^|[^a-z])u?u?id|_id|guid|cert(?:ificate)?|public_?key|cursor)s?["'\]]{0,2}\s*(?:[:=]{1,2}>?|\s)\s*[bru]?["'`]?$|(?-i:[a-z]Id)["'\]]{0,2}\s*[:=]\s*["'`]?$|base64,$|sha\d+[-:]$|ssh-\w+\s+$""")
ID_START = re.compile(r"^(?:toolu|call|msg|req|resp|run|thread|sess|session|chatcmpl|evt|file|step|asst|item|conv|trace|span)[_\-]")
ULID = re.compile(r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$")
BINARY = re.compile(r"^(?:iVBORw0KGgo|/9j/|R0lGOD|UEsDB|JVBERi0|AGFzbQ|H4sI|PHN2Zy|d09GM)")
#: Sizes of the sets of characters that a generated text is drawn from.
CHARACTERS = ((26, re.compile("[a-z]")), (26, re.compile("[A-Z]")), (10, re.compile("[0-9]")), (2, re.compile(r"[^A-Za-z0-9]")))
PARTS = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


#: No rule takes a value under six characters.
LEAST = 6


class Span(NamedTuple):
    start: int
    end: int
    rule: str


def entropy(s: str) -> float:
    """Bits for each character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def random_enough(s: str, share: float) -> bool:
    """Entropy above `share` of what a text of this length in this alphabet can have."""
    bits = next(b for p, b in ALPHABETS if p.search(s))
    return entropy(s) >= share * min(bits, math.log2(len(s))) if len(s) > 1 else False


@lru_cache(maxsize=4096)
def expected_entropy(n: int, k: int) -> float:
    """Bits for each character that n even draws from k characters show on average."""
    p, out = (1 - 1 / k) ** n, 0.0
    for c in range(1, min(n, 40 + 4 * n // k)):
        p *= (n - c + 1) / c / (k - 1)
        out -= k * p * c / n * math.log2(c / n)
    return out


def harmless(s: str) -> bool:
    return bool(REFERENCE.search(s) or PLACEHOLDER.search(s) or HASH.search(s))


def like_password(s: str, least: int = 6) -> bool:
    """A chosen password: not a plain word, number or reference; digits or signs among letters."""
    if len(s) < least or harmless(s) or not re.search("[A-Za-z]", s) or any(c.isspace() for c in s):
        return False
    if not re.search(r"\d", s):
        mixed = re.search("[a-z]", s) and re.search("[A-Z]", s) and len(s) >= 12 and re.fullmatch(r"[A-Za-z0-9+/=]+", s)
        return bool(mixed and random_enough(s, 0.85))
    return random_enough(s, 0.7)


def like_token(s: str) -> bool:
    """A generated token: long, letters and digits (or letters in ever changing case), high entropy."""
    if len(s) < 12 or harmless(s) or " " in s or not re.search("[A-Za-z]", s):
        return False
    if not re.search(r"\d", s):
        turns = len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", s))
        return len(s) >= 16 and turns * 4 >= len(s) and s.isalpha() and random_enough(s, 0.85)
    return random_enough(s, 0.72)


def generated(s: str, least: int = 20) -> bool:
    """A generated secret by itself, whatever stands around it.

    Beside the entropy, the kind of character (lower, upper, digit) must change nearly as often as in random text: the
    entropy of a short identifier of many different letters is as high.
    """
    if len(s) < least:
        return False
    size = sum(n for n, p in CHARACTERS if p.search(s))
    if entropy(s) < 0.9 * expected_entropy(min(len(s), 1000), size) or harmless(s) or UUID.match(s) or ULID.match(s) or ID_START.match(s) or BINARY.match(s):
        return False
    if any(not c.isalnum() and c not in "+/=_-.~" for c in s):
        kinds = ["l" if c.islower() else "U" if c.isupper() else "9" if c.isdigit() else "!" for c in s]
        return len(set(kinds)) == 4 and not re.search(r"[()\[\]{}|^,;]|://", s) and sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.5 * len(s)
    parts = PARTS.findall(s)
    if not parts or max(map(len, parts)) < 10 or re.fullmatch(r"[0-9a-f\-:]+|[0-9A-F\-:]+", s):
        return False
    kinds = [["l" if c.islower() else "U" if c.isupper() else "9" for c in p] for p in parts]
    n, turns = sum(map(len, kinds)), sum(a != b for k in kinds for a, b in zip(k, k[1:]))
    found = {c for k in kinds for c in k}
    if "U" in found and len(re.findall(r"\d+", s)) < 2 and n >= 3 * len(WORD.findall(s)):
        return False  # words joined to a name
    if len(found) == 3:
        return turns >= 0.35 * n
    return turns >= (0.4 if found == {"l", "U"} else 0.3) * n and len(found) == 2


def said_aloud(word: str, s: str) -> bool:
    """A value that follows the bare word in prose."""
    if like_token(s):
        return True
    return like_password(s, 7) and (word == "pass" or bool(re.search(r"\d", s) and re.search(r"[A-Z!%$#?*&@]", s)))


def _basic(s: str) -> bool:
    try:
        text = base64.b64decode(s + "=" * (-len(s) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = text.partition(":")
    return bool(colon and text.isprintable() and password and not harmless(password))


def _joined(text: str, end: int) -> tuple[str, int]:
    """What further literals joined to the one that ends at `end` add, and the new end."""
    more = ""
    while m := JOINED.match(text, end):
        if m[1] != m[2]:
            break
        more += m[3]
        end = m.end()
    return more, end


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _at(low: str, word: str) -> Iterator[int]:
    i = low.find(word)
    while i >= 0:
        yield i
        i = low.find(word, i + 1)


def find(text: str) -> list[Span]:
    """Credentials of a text in order of position; spans may overlap. Plain substring searches decide which patterns run;
    time is in proportion to the length."""
    out: list[Span] = []
    if len(text) < LEAST:
        return out
    low = _lower(text)
    if "PRIVATE KEY" in text:
        heads = list(PRIVATE_KEY.finditer(text))
        for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
            stop = KEY_END.search(text, m.end(), after)
            if KEY_BODY.search(text, m.end(), stop.start() if stop else after):
                out.append(Span(m.start(), stop.end() if stop else KEY_REST.match(text, m.end(), after).end(), "private_key"))
    if any(w in text for w in VENDOR_WORDS):
        for m in VENDOR_START.finditer(text):
            more, end = _joined(text, m.end())
            value = m[0] + more
            if (v := VENDOR.match(value)) and not PLACEHOLDER.search(v[0]) and random_enough(v[0], 0.6) and (v[0][:3] != "sk-" or max(map(len, PARTS.findall(v[0]))) >= 16):
                out.append(Span(m.start(), end if more else m.start() + len(v[0]), "vendor"))
    if "://" in text and "@" in text:
        for m in URL.finditer(text):
            if not harmless(m[2]) and len(m[2]) >= 4:
                out.append(Span(m.start(2), m.end(2), "url"))
    if "bearer " in low or "basic " in low or "authorization: token" in low:
        for m in HEADER.finditer(text):
            ok = _basic(m[2]) if m[1].lower() == "basic" else like_token(m[2])
            if ok:
                out.append(Span(m.start(2), m.end(2), "header"))
    if " -p" in text:
        out += [Span(m.start(2), m.end(2), "option") for m in _short_options(text) if like_password(m[2])]
    for sign, p in ((" --", OPTION), (" -u ", USER_OPTION), (" --user", USER_OPTION)):
        if sign in text:
            out += [Span(m.start(2), m.end(2), "option") for m in p.finditer(text) if like_password(m[2])]
    if "<property" in text or "value=" in text:
        out += [Span(m.start(2), m.end(2), "named") for m in XML_PAIR.finditer(text) if _named(m[1], m[2])]
    for word in WORDS:
        done = value_end = 0
        for at in _at(low, word):
            a = at
            if a == 0 or not text[a - 1].isalnum():
                m = SAID.match(text, a if word != "key" or low[max(0, a - 4) : a] != "api " else a - 4)
                if m and said_aloud(word, m[2]):
                    out.append(Span(m.start(2), m.end(2), "said"))
            if at < done:
                continue  # the same name
            while a > done and (text[a - 1].isalnum() or text[a - 1] in "_-."):
                a -= 1
            done = z = NAME_END.match(text, at + len(word)).end()
            name = text[a:z]
            if a < value_end and text[a - 1] in "=:>":
                continue  # a value that looks like a name
            m = REST.match(text, z)
            if m:
                more, end = _joined(text, m.end(3))
                if _named(name, m[3] + more):
                    out.append(Span(m.start(3), end if more else m.end(3), "named"))
            elif m := REST_PLAIN.match(text, z):
                value_end = m.end(1)
                if _named(name, m[1].rstrip(".")):
                    out.append(Span(m.start(1), m.end(1), "named"))
    out += _bare(text, out)
    return sorted(set(out))


def _short_options(text: str) -> Iterator[re.Match]:
    """The first -p of every command that takes a password there."""
    for m in COMMAND.finditer(text):
        if text.find(" -p", m.start(), m.end()) >= 0 and (login := LOGIN.search(text, m.start(), m.end())) and (p := SHORT_OPTION.search(text, login.end(), m.end())):
            yield p


def _bare(text: str, known: list[Span]) -> Iterator[Span]:
    """Every literal and long token that is generated text by itself, in no span of `known` and no PEM block."""
    taken: list[list[int]] = []  # disjoint, in order
    for a, z in sorted([(s.start, s.end) for s in known] + ([m.span() for m in PEM.finditer(text)] if "-----BEGIN" in text else [])):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], z)
        else:
            taken.append([a, z])
    for pattern, group, least in ((LITERAL, 2, 16), (LONG, 0, 20)):
        for m in pattern.finditer(text):
            a, z = m.span(group)
            if HASH.search(m[group]):
                continue
            quote = text[a - 1 : a]
            more, end = _joined(text, z) if quote and quote in "\"'" and text[z : z + 1] == quote else ("", z)
            for start, value in _values(m[group] + more, a) if not more else [(a, m[group] + more)]:
                stop = end if more else start + len(value)
                if generated(value, least if quote and quote in "\"'`" else 20) and not NOT_SECRET.search(text[max(0, start - 40) : start]):
                    i = bisect_left(taken, [stop])
                    if not i or taken[i - 1][1] <= start:
                        yield Span(start, stop, "generated")


def _values(token: str, at: int) -> Iterator[tuple[int, str]]:
    """(start, value) of the token itself, and of its parts if it is a path, an address, a query or an assignment."""
    if not re.search(r"[:?&,;]|=(?=[^=])|^[./~]|/.*\.|^\w+\.\w+\.", token) and not token.startswith("//"):
        yield at, token.rstrip(".")
        return
    for m in re.finditer(r"[^:?&,;/=.]{16,}=*", token):
        yield at + m.start(), m[0]


def _named(name: str, value: str) -> bool:
    n = re.sub(r"[^a-z0-9]", "", name.rsplit(".", 1)[-1].lower())
    if NO_NAME.search(n):
        return False
    if STRONG_NAME.search(n):
        return like_password(value) if not UUID.match(value) else True
    return bool(TOKEN_NAME.search(n)) and (like_token(value) or bool(UUID.match(value)))


def lines(text: str) -> list[int]:
    """Line numbers (from 1, split at newline) on which a credential begins."""
    found = find(text)
    return sorted({text.count("\n", 0, s.start) + 1 for s in found})


def mask(text: str | None) -> str | None:
    """The text with every credential replaced; quotes, names and line breaks around it stay."""
    if not text:
        return text
    out, last = [], 0
    for a, z, newlines in _hidden(text, find(text)):
        out += [text[last:a], MASK, "\n" * newlines]
        last = z
    return "".join(out) + text[last:]


def _hidden(text: str, spans: list[Span]) -> Iterator[tuple[int, int, int]]:
    """(start, end, line ends to keep) of what is replaced; where spans overlap, the rest of the later one."""
    last = 0
    for s in spans:
        if s.end > last:
            a = max(s.start, last)
            hidden = text[a : s.end]
            yield a, s.end, hidden.count("\n") if s.rule == "private_key" and '"' not in hidden and "'" not in hidden else 0
            last = s.end


def strings(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, text) of every string in a decoded JSON value; array items share their array's path."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from strings(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v, path)


def in_files(files: DataFrame) -> DataFrame:
    """(origin, row_id, field, line_no) of file_id, content."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([("source_files", i, "content", n) for i, t in zip(b["file_id"], b["content"]) if t for n in lines(t)], columns=["origin", "row_id", "field", "line_no"])

    return files.select("file_id", "content").mapInPandas(go, "origin string, row_id long, field string, line_no int")


def in_records(records: DataFrame) -> DataFrame:
    """(origin, row_id, field, line_no) of record_id, raw; a line that is no JSON has none."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, raw in zip(b["record_id"], b["raw"]):
                try:
                    value = json.loads(raw)
                except (ValueError, TypeError, RecursionError):
                    continue
                for path, text in strings(value):
                    rows += [("hook_records", i, path, n) for n in lines(text)]
            yield pd.DataFrame(rows, columns=["origin", "row_id", "field", "line_no"]).drop_duplicates()

    return records.select("record_id", "raw").mapInPandas(go, "origin string, row_id long, field string, line_no int")


def masked(df: DataFrame, column: str) -> DataFrame:
    """`df` with the credentials in a text column masked."""

    @F.pandas_udf("string")
    def hide(s: pd.Series) -> pd.Series:
        return s.map(mask)

    return df.withColumn(column, hide(F.col(column)))


JSON_STRING = re.compile(r'"((?:[^"\\]|\\.)*+)"(\s*:)?')
#: One character of a string as it is written; a pair of surrogates is one.
JSON_CHAR = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.", re.S)


def mask_json(raw: str | None) -> str | None:
    """A line of JSON with the credentials in its strings masked where they stand; all else stays byte for byte, and so
    does a line that is no JSON."""
    try:
        json.loads(raw)
    except (ValueError, TypeError, RecursionError):
        return raw
    out, last = [], 0
    for m in JSON_STRING.finditer(raw):
        if m[2] or m.end(1) - m.start(1) < LEAST:
            continue
        text = json.loads(f'"{m[1]}"') if "\\" in m[1] else m[1]
        spans = find(text)
        if not spans:
            continue
        # Where each character of the text stands in the line.
        at = [x.start() for x in JSON_CHAR.finditer(raw, m.start(1), m.end(1))] if "\\" in m[1] else range(m.start(1), m.end(1))
        at = [*at, m.end(1)]
        for a, z, newlines in _hidden(text, spans):
            out += [raw[last : at[a]], MASK, "\\n" * newlines]
            last = at[z]
    return "".join(out) + raw[last:] if out else raw


def masked_records(df: DataFrame, column: str = "raw") -> DataFrame:
    """`df` with the credentials inside the strings of a JSON column masked."""

    @F.pandas_udf("string")
    def hide(s: pd.Series) -> pd.Series:
        return s.map(mask_json)

    return df.withColumn(column, hide(F.col(column)))
