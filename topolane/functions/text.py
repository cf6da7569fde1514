"""Text functions as JVM-side column expressions: token estimate, redaction, identifier words, globs, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that str.strip() removes, i.e. Unicode white space with the ASCII separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

LEXICAL = r"\p{IsAlphabetic}\p{N}_"
RUN_PATTERN = rf"[{LEXICAL}]+|[^\p{{IsWhite_Space}}{LEXICAL}]+"

#: Credential markers of the ledger (fixed values).
REDACT_MARKERS = ("API_KEY=", "XAI_KEY=", "TOKEN=", "SECRET=", "PASSWORD=", "AUTHORIZATION: BEARER ")


def strip_white(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(c, F.lit(WHITE))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def class_runs(c: Column) -> Column:
    """Number of maximal runs of lexical or of punctuation characters (white space separates)."""
    return F.regexp_count(c, F.lit(RUN_PATTERN)).cast("bigint")


def tokens_from(n_bytes: Column, runs: Column) -> Column:
    """ceil(1.05 * max(ceil(bytes / 3), runs)) in integer arithmetic."""
    base = F.greatest(F.floor((n_bytes.cast("bigint") + 2) / 3), runs.cast("bigint"))
    return F.floor((base * 105 + 99) / 100).cast("bigint")


def estimate_tokens(c: Column) -> Column:
    """Deterministic token estimate; 0 for empty, null for null."""
    return tokens_from(F.octet_length(c), class_runs(c))


def redact_text(c: Column) -> Column:
    """First 12 lines; a line with a credential marker becomes [REDACTED], others keep 160 characters."""
    lines = F.split(F.regexp_replace(F.regexp_replace(c, r"\r\n", "\n"), r"\n\z", ""), "\n", -1)

    def one(line: Column) -> Column:
        up = ascii_upper(line)
        hit = F.lit(False)
        for m in REDACT_MARKERS:
            hit = hit | up.contains(m)
        return F.when(hit, F.lit("[REDACTED]")).otherwise(F.substring(line, 1, 160))

    return F.array_join(F.transform(F.slice(lines, 1, 12), one), "\n")


def identifier_words(c: Column) -> Column:
    """Words of an identifier: cut at other characters and at lower-to-upper steps; ASCII letters in lower case."""
    spaced = F.regexp_replace(c, r"([\p{Ll}])(?=[\p{Lu}])", "$1 ")
    words = F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "), " ", -1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.translate(w, upper, lower))


def truncate(c: Column, n: int) -> Column:
    """At most n characters; the last becomes an ellipsis if something was cut."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def bounded(c: Column, n: int, marker: str = "\n[output truncated]") -> Column:
    """If longer than n characters, keep n-30 and a marker line."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, max(n - 30, 0)), F.lit(marker))).otherwise(c)


def glob_regex(pattern: str) -> str:
    """Anchored regex of a path glob: `*` stays inside a segment, `**` crosses, `?` is one non-slash character."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


def glob_matches(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def normalize_path(c: Column) -> Column:
    """Backslashes to slashes, leading `./` and outer slashes removed."""
    slashed = F.translate(c, "\\", "/")
    return F.trim(F.regexp_replace(slashed, r"^(?:\./)+", ""), F.lit("/"))


def suffix_keys(c: Column, sep: str = "::") -> Column:
    """All `sep`-suffixes of a qualified name, the whole name included."""
    parts = F.split(c, re.escape(sep), -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))


def latency_bucket(ms: Column) -> Column:
    return F.when(ms < 10, "lt_10").when(ms < 100, "lt_100").when(ms < 1000, "lt_1000").otherwise("ge_1000")


#: Fixed values of the intent rules, in order of precedence.
RESUME_WORDS = ("resume", "continue", "pick up", "blocked", "failed", "failure")
CHANGE_WORDS = ("change", "changed", "impact", "worktree", "affected", "tests")
FLOW_WORDS = (" flow ", " reach ", " path ", " calls ")
INSPECT_WORDS = ("source", "implementation", "inspect", "show code", "read ")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def classify_intent(c: Column) -> Column:
    """Intent of a question; the first rule that applies: resume, change, flow, inspect, locate."""
    low = ascii_lower(c)
    return (
        F.when(contains_any(low, RESUME_WORDS), "resume")
        .when(contains_any(low, CHANGE_WORDS), "change")
        .when(low.startswith("how ") | contains_any(low, FLOW_WORDS), "flow")
        .when(contains_any(low, INSPECT_WORDS), "inspect")
        .otherwise("locate")
    )
