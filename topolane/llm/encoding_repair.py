"""Garbled text from a wrong character encoding: find it and restore what can be restored.

Units are the runs of non-ASCII characters of a text with two characters of context. Each chain of encodings (written as
one encoding, read as another) that can be undone on a unit gives a hypothesis beside "intact". A character-bigram model,
counted over the whole corpus, scores them; expectation-maximisation then learns how common each chain is in each source
and field, so that weak evidence in one record is judged by what its neighbours show, and every unit gets the
posterior of its best chain. A document is a case if some unit's best chain is more probable than "intact".

Replacement characters are cases that cannot be restored (chain "lost"); the text on either side of one is judged by itself. A back-tick quotation is no case if it is a lone
replacement character or if its restored form is quoted on the same line: such a text talks about garbled characters.

Cases: null, empty and ASCII texts are intact; null sources and kinds are groups of their own; repeated texts are judged
alike; texts of any length are read whole; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topolane.session import cut

LOST, LOST_MARK = "lost", "\ufffd"
INTACT = "intact"
#: Most rounds of estimation, and the change of shares at which they end.
ROUNDS, TOLERANCE = 6, 0.01
#: A model of at most so many pairs (about 60 bytes each), and weights of as many alternatives (16 bytes), are broadcast.
BROADCAST = 500_000
#: Share of units assumed garbled before anything is known: by a chain through UTF-8, whose structure is evidence in
#: itself, and by any other; WEIGHT is the pseudo-count of that belief.
PRIOR_UTF8, PRIOR_OTHER, WEIGHT = 0.02, 2e-4, 20.0
#: Pairs of ASCII characters are not counted; each costs ASCII_PAIR, a step from ASCII to another character LEAVE_ASCII
#: besides its share among such steps, a pair never seen BACKOFF besides the share of its second character.
ASCII_PAIR, LEAVE_ASCII, BACKOFF, UNSEEN = -2.4, -2.5, -2.5, 0.02
#: That both bytes of a 16-bit character are printable ASCII has a chance of about e^-2, which each of the two is credited.
WIDE_CREDIT = 1.0
FLUSH = 500_000
#: Encodings in which UTF-8 bytes were read; "sloppy" ones pass undefined bytes on as control characters.
READ_AS = ("cp1252", "latin1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "mac_roman", "cp1253", "cp1254", "cp866")
#: Pairs (written in, read as) of encodings without the structure of UTF-8.
LEGACY = (
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp866", "cp1252"),
    ("iso8859-5", "cp1252"), ("cp1253", "cp1252"), ("iso8859-7", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"),
    ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp1253"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "mac_roman"), ("mac_cyrillic", "cp1252"),
)
WHOLE_WORDS = ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "mac_cyrillic")
#: Double-byte encodings read as a single-byte one.
WIDE = ("shift_jis", "euc_jp", "gbk", "big5", "euc_kr")

#: ASCII between null characters is text of 16 bits; a replacement character stands alone, so that the text on either side of it is a unit of its own.
RUN = re.compile(r"\ufffd+|(?:[\x20-\x7e\t\r\n]\x00){4,}|(?:\x00[\x20-\x7e\t\r\n]){4,}|[^\x00-\x7f\ufffd](?:[\x40-\x7e]?[^\x00-\x7f\ufffd])*[\x40-\x7e]?")
QUOTED = re.compile(r"`[^`\n]+`")
WIDE_RUN = re.compile(r"[^\x00-\x7f]{3,}")
ASCII_TEXT = re.compile("[ -~\t\r\n]{4,}")


def as_ascii(s: str, enc: str) -> str:
    """ASCII text whose bytes were read in pairs, or `s` itself."""
    try:
        text = s.encode(enc).decode("ascii")
    except UnicodeError:
        return s
    return text if ASCII_TEXT.fullmatch(text) else s


def through_gbk(s: str, cut_start: bool, cut_end: bool) -> str | None:
    """`s` whose UTF-8 bytes were read as GBK, or None. gb18030 also has the private-use characters that readers put for
    unassigned pairs. At a cut the bytes left of a lost character are dropped: the mark beside them stands for it."""
    try:
        data = s.encode("gb18030")
    except UnicodeError:
        return None
    starts = [0]
    if cut_start:
        starts += range(1, 4)
    for a in starts:
        if any(b & 0xC0 != 0x80 for b in data[:a]):
            break
        for z in range(len(data), len(data) - (4 if cut_end else 1), -1):
            rest = data[z:]
            # What is dropped at the end must be the unfinished start of one character.
            if rest and not (rest[0] >= 0xC2 and all(b & 0xC0 == 0x80 for b in rest[1:])):
                continue
            try:
                text = data[a:z].decode("utf-8")
            except UnicodeDecodeError:
                continue
            return text or None
    return None


def _table(enc: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            ch = chr(b)
        if len(ch) == 1:
            out.setdefault(ch, b)
    # Readers that keep control characters for undefined bytes.
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


class Chains:
    """Inverse tables and patterns, built once a worker."""

    held: Chains | None = None

    def __init__(self):
        self.back = {e: _table(e) for e in {*READ_AS, *(r for _, r in LEGACY)}}
        self.pattern = {}
        for e in READ_AS:
            by: dict[str, str] = {}
            kind = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in self.back[e].items() if lo <= b <= hi) + "]"  # noqa: B023, E731
            by = {"t": kind(0x80, 0xBF), "2": kind(0xC2, 0xDF), "3": kind(0xE0, 0xEF), "4": kind(0xF0, 0xF4)}
            self.pattern[e] = re.compile("(?:{2}{t}|{3}{t}{t}|{4}{t}{t}{t})+".replace("{t}", by["t"]).replace("{2}", by["2"]).replace("{3}", by["3"]).replace("{4}", by["4"]))
        self.seen: dict[tuple[str, bool, bool], list[tuple[str, str]]] = {}

    @classmethod
    def get(cls) -> Chains:
        if cls.held is None:
            cls.held = cls()
        return cls.held

    def raw(self, s: str, enc: str) -> bytes | None:
        back, out = self.back[enc], bytearray()
        for ch in s:
            if ch < "\x80":
                out.append(ord(ch))
            elif (b := back.get(ch)) is not None:
                out.append(b)
            else:
                return None
        return bytes(out)

    def from_utf8(self, s: str, enc: str) -> str | None:
        """`s` with every valid UTF-8 sequence put back, or None where there is none."""
        changed = False

        def put(m: re.Match) -> str:
            nonlocal changed
            try:
                got = self.raw(m[0], enc).decode("utf-8")
            except UnicodeDecodeError:
                return m[0]
            changed = True
            return got

        out = self.pattern[enc].sub(put, s)
        return out if changed else None

    def hypotheses(self, run: str, left: str = "", right: str = "") -> list[tuple[str, str]]:
        """(chain, restored) of a run; each restored text once, under the first chain that gives it. `left` and `right` are
        its context: beside a replacement character the run may begin or end inside a character."""
        cuts = left.endswith(LOST_MARK), right.startswith(LOST_MARK)
        key = (run, *cuts)
        if (got := self.seen.get(key)) is not None:
            return got
        out: dict[str, str] = {}
        if "�" in run:
            got = [(LOST, "")]
            self.keep(key, got)
            return got
        if "\x00" in run:
            # ASCII in 16 bits a character, read byte by byte.
            got = [("utf-16>latin1", run.replace("\x00", ""))]
            self.keep(key, got)
            return got
        for e in READ_AS:
            once = self.from_utf8(run, e)
            if once is not None and once != run:
                out.setdefault(once, f"utf-8>{e}")
                twice = self.from_utf8(once, e)
                if twice is not None and twice != once:
                    out.setdefault(twice, f"utf-8>{e} twice")
        whole = through_gbk(run, *cuts)
        if whole is not None and whole != run:
            out.setdefault(whole, "utf-8>gbk")
        elif whole is None:
            for m in re.finditer(r"[　-鿿-￯]+", run):
                part = through_gbk(m[0], cuts[0] and m.start() == 0, cuts[1] and m.end() == len(run))
                if part is not None and part != m[0]:
                    out.setdefault(run[: m.start()] + part + run[m.end() :], "utf-8>gbk")
        high = sum(ch >= "\x80" for ch in run)
        for written, read in LEGACY:
            # Greek and Cyrillic come in whole words, accents of the Latin script one or two at a time.
            if (high < 2) if written in WHOLE_WORDS else (high > 2 and read in WHOLE_WORDS):
                continue
            data = self.raw(run, read)
            try:
                text = data.decode(written) if data is not None else run
            except UnicodeDecodeError:
                continue
            if text != run and all(ch.isalpha() or ch < "\x80" for ch in text):
                out.setdefault(text, f"{written}>{read}")
        if high >= 4 and (data := self.raw(run, "cp1252")) is not None:
            for e in WIDE:
                for tail in (data, data[:-1]):
                    try:
                        got_text = tail.decode(e) + data[len(tail) :].decode("ascii")
                    except UnicodeDecodeError:
                        continue
                    out.setdefault(got_text, f"{e}>cp1252")
                    break
                else:
                    for part in [data[1:]] * cuts[0] + [data[:-1]] * cuts[1] + [data[1:-1]] * all(cuts):
                        try:
                            out.setdefault(part.decode(e), f"{e}>cp1252")
                            break
                        except UnicodeDecodeError:
                            pass
        if high >= 3:
            for e in ("utf-16-le", "utf-16-be"):  # little-endian is what a reader assumes without a mark
                text = WIDE_RUN.sub(lambda m: as_ascii(m[0], e), run)  # noqa: B023
                if text != run:
                    out.setdefault(text, f"utf-8>{e}")
                    break
        got = [(c, t) for t, c in out.items()]
        self.keep(key, got)
        return got

    def keep(self, key: tuple[str, bool, bool], got: list) -> None:
        if len(self.seen) >= 200_000:
            self.seen.clear()
        if len(key[0]) <= 64:
            self.seen[key] = got


def mentioned(text: str) -> list[tuple[int, int]]:
    """Quotations that only mention garbled characters: a lone replacement character, or a text whose restored form is
    quoted on the same line."""
    out = []
    by_line: dict[int, list] = {}
    for m in QUOTED.finditer(text):
        by_line.setdefault(text.rfind("\n", 0, m.start()), []).append((m.span(), m[0][1:-1]))
    for spans in by_line.values():
        said = {s for _, s in spans}
        for span, s in spans:
            if s.isascii():
                continue
            if s == "�":
                out.append(span)
            elif len(said) > 1:
                c = Chains.get()
                tries = [c.from_utf8(s, e) for e in READ_AS]
                for written, read in LEGACY:
                    if (data := c.raw(s, read)) is not None:
                        tries.append(data.decode(written, "replace"))
                if any(t is not None and t != s and t in said for t in tries):
                    out.append(span)
    return sorted(out)


def runs(text: str) -> list[tuple[int, int]]:
    """Spans of the units of a text, mentions left out."""
    quoted = mentioned(text) if "`" in text else []
    out, q = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while q < len(quoted) and quoted[q][1] <= a:
            q += 1
        if q < len(quoted) and quoted[q][0] <= a:
            continue
        out.append((a, b))
    return out


def pairs(s: str) -> list[str]:
    return [s[i : i + 2] for i in range(len(s) - 1) if s[i] >= "\x80" or s[i + 1] >= "\x80"]


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: units with some hypothesis (doc, source, kind, left, run, right, n) and bigram counts
    (doc null, run = the pair), combined within a partition."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Chains.get()
        counts: Counter[str] = Counter()
        cols = ["doc_id", "source", "kind", "left", "run", "right", "n"]

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(None, None, None, None, k, None, v) for k, v in counts.items()], columns=cols)
            counts.clear()
            return out

        for b in batches:
            rows = []
            for doc, source, kind, text in zip(b["doc_id"], b["source"], b["kind"], b["text"]):
                if not text or text.isascii() and "\x00" not in text:
                    continue
                units: Counter = Counter()
                for a, z in runs(text):
                    run = text[a:z]
                    left, right = text[max(0, a - 2) : a], text[z : z + 2]
                    counts.update(pairs(left + run + right))
                    if c.hypotheses(run, left, right):
                        units[(left, run, right)] += 1
                rows += [(doc, source, kind, x, y, w, n) for (x, y, w), n in units.items()]
            if rows:
                yield pd.DataFrame(rows, columns=cols)
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    schema = "doc_id long, source string, kind string, left string, run string, right string, n long"
    return docs.where("text is not null and text rlike '[^\\\\x01-\\\\x7f]'").mapInPandas(go, schema)


def alternatives(units: DataFrame) -> DataFrame:
    """(uid, left, right, chain, restored) of each distinct unit; "intact" among them."""
    cols = ["uid", "left", "right", "chain", "restored"]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Chains.get()
        for b in batches:
            rows = []
            for i, x, y, w in zip(b["uid"], b["left"], b["run"], b["right"]):
                rows.append((i, x, w, INTACT, y))
                rows += [(i, x, w, chain, t) for chain, t in c.hypotheses(y, x, w)]
            yield pd.DataFrame(rows, columns=cols)

    return units.mapInPandas(go, "uid long, left string, right string, chain string, restored string")


def model(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(gram, n_gram, n_first, n_second, total) of every pair in `vocabulary` (gram): a few numbers for each distinct pair."""
    parts = counts.withColumns({"first": F.substring("gram", 1, 1), "second": F.substring("gram", 2, 1)})
    of_first = parts.groupBy("first").agg(F.sum("n").alias("n_first"))
    of_second = parts.groupBy("second").agg(F.sum("n").alias("n_second"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(1e6)).alias("total"))  # one row
    seen = vocabulary.withColumns({"first": F.substring("gram", 1, 1), "second": F.substring("gram", 2, 1)})
    seen = seen.join(counts.withColumnRenamed("n", "n_gram"), "gram", "left").join(of_first, "first", "left").join(of_second, "second", "left")
    return seen.join(F.broadcast(total)).select("gram", "n_gram", "n_first", "n_second", "total")


def fitted(weighted: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """(id, uid, chain, fit): the log-probability of each alternative under the model.

    `weighted` has an alternative's pairs (`gs`, an array of gram and times) and `w`, what it has put into the counts.
    Leave-one-out: one occurrence, at most w, is taken out before it is judged, so that a garbled run that occurs once is
    no evidence for itself. The model is broadcast while it has at most BROADCAST pairs, and joined by pair beyond.
    """
    rows = weighted.select("id", "uid", "chain", "plain", F.least(F.coalesce("w", F.lit(0.0)), F.lit(1.0)).alias("w"), F.explode_outer("gs").alias("g")).select("id", "uid", "chain", "plain", "w", "g.*")
    seen = rows.join(F.broadcast(known) if n_known <= BROADCAST else known, "gram", "left")
    none = F.lit(0.0)
    less = lambda c: F.greatest(F.coalesce(F.col(c), none) - F.col("times") * F.col("w"), none)
    single = F.log((less("n_second") + UNSEEN) / (F.col("total") + 1.0)) + BACKOFF
    cost = F.greatest(F.log((less("n_gram") + UNSEEN * UNSEEN) / (less("n_first") + 1.0)), single)
    cost = cost + F.when(F.ascii("gram") < 128, LEAVE_ASCII).otherwise(0.0)
    return seen.groupBy("id", "uid", "chain", "plain").agg(F.sum(F.col("times") * cost).alias("logp")).select("id", "uid", "chain", (F.coalesce("logp", none) + F.col("plain")).alias("fit"))


def judge(docs: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, source, kind, left, run, right, n, chain, restored, posterior) of every garbled unit.

    `docs` has doc_id, source, kind and text. Each round estimates from the posteriors of the last one: the share of
    every chain in each (source, kind), and the pair counts of the text as it was before it was garbled; it ends when no
    share changes by more than `tolerance`, at the latest after `rounds`. Everything grows with the distinct suspicious
    units, not with the texts; an alternative and its pairs are one row, exploded only behind the last exchange.
    """
    seen = cut(scan(docs))
    counts = cut(seen.where("doc_id is null").groupBy(F.col("run").alias("gram")).agg(F.sum("n").cast("double").alias("n")))
    rows = seen.where("doc_id is not null")
    keys, group = ["left", "run", "right"], ["source", "kind"]
    gone = rows.where(F.instr("run", LOST_MARK) > 0).select("doc_id", *group, *keys, "n", F.lit(LOST).alias("chain"), F.lit("").alias("restored"), F.lit(1.0).alias("posterior"))
    rows = rows.where(F.instr("run", LOST_MARK) == 0)

    @F.pandas_udf("array<struct<gram:string,times:int>>")
    def grams_of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"gram": g, "times": n} for g, n in Counter(pairs(x)).items()])

    # Units get numbers: one join on their strings, none after it.
    named = cut(rows.select(*keys).distinct().withColumn("uid", F.monotonically_increasing_id()))
    units = cut(rows.join(named, keys).select("doc_id", *[F.coalesce(c, F.lit("")).alias("g_" + c) for c in group], *group, "uid", "n"))
    group = ["g_source", "g_kind"]
    alts = alternatives(named).withColumn("whole", F.concat("left", "restored", "right")).withColumn("gs", grams_of("whole"))
    n_pairs = F.aggregate("gs", F.lit(0), lambda a, g: a + g["times"])
    credit = F.when(F.col("chain").startswith("utf-8>utf-16"), WIDE_CREDIT).otherwise(0.0)
    alts = alts.withColumn("plain", F.greatest(F.char_length("whole") - 1 - n_pairs, F.lit(0)) * (F.lit(ASCII_PAIR) + credit))
    alts = cut(alts.select("uid", "chain", "restored", "plain", "gs").withColumn("id", F.monotonically_increasing_id()))
    carried = alts.select("id", "uid", "chain", "plain", "gs")
    vocabulary = cut(alts.select(F.explode("gs.gram").alias("gram")).distinct())
    n_known = vocabulary.count()
    # What a unit says does not depend on its document: units are pooled per group before the rounds.
    told = cut(units.groupBy(*group, "uid").agg(F.sum("n").alias("n")))
    own = told.groupBy("uid").agg(F.sum("n").cast("double").alias("w")).withColumn("chain", F.lit(INTACT))
    n_alts = alts.count()
    # What each alternative has put into the counts: one number, joined to its pairs without moving them.
    beside = lambda w: carried.join(F.broadcast(w) if n_alts <= BROADCAST else w, "id", "left")
    weighted = beside(cut(carried.select("id", "uid", "chain").join(own, ["uid", "chain"]).select("id", "w")))
    expect = lambda df: df.where("w > 0").select("w", F.explode("gs").alias("g")).groupBy("g.gram").agg(F.sum(F.col("g.times") * F.col("w")).alias("n"))
    merged = lambda a, b: a.unionByName(b).groupBy("gram").agg(F.sum("n").alias("n"))
    # Pairs outside the suspicious units, which no round changes.
    outside = cut(merged(counts, expect(weighted).select("gram", (-F.col("n")).alias("n"))))
    prior = F.when(F.col("chain") == INTACT, 1.0).when(F.col("chain").startswith("utf-8>"), PRIOR_UTF8).otherwise(PRIOR_OTHER)
    beliefs, now = None, counts
    unit, whole = Window.partitionBy(*group, "uid"), Window.partitionBy(*group)
    for r in range(rounds):
        fit = fitted(weighted, cut(model(now, vocabulary)), n_known)
        known = told.join(fit, "uid")
        known = known.withColumn("belief", prior) if beliefs is None else known.join(beliefs, [*group, "chain"], "left").withColumn("belief", F.coalesce("belief", prior))
        known = known.withColumn("weight", F.log("belief") + F.col("fit"))
        known = known.withColumn("p", F.exp(F.greatest(F.col("weight") - F.max("weight").over(unit), F.lit(-60.0))))
        known = cut(known.withColumn("p", F.col("p") / F.sum("p").over(unit)).select(*group, "uid", "id", "chain", "n", "p"))
        if r == rounds - 1:
            break
        mass = known.groupBy(*group, "chain").agg(F.sum(F.col("p") * F.col("n")).alias("mass")).withColumn("all", F.sum("mass").over(whole))
        shares = cut(mass.select(*group, "chain", ((F.col("mass") + WEIGHT * prior) / (F.col("all") + WEIGHT)).alias("belief")))
        if beliefs is not None:
            was = beliefs.withColumnRenamed("belief", "was")
            change = shares.join(was, [*group, "chain"], "left").agg(F.max(F.abs(F.col("belief") - F.coalesce("was", F.lit(0.0))))).first()[0]
            if change is None or change <= tolerance:
                break
        beliefs = shares
        weighted = beside(cut(known.groupBy("id").agg(F.sum(F.col("p") * F.col("n")).alias("w"))))
        now = merged(outside, expect(weighted))
    best = known.groupBy(*group, "uid").agg(F.max_by(F.struct("id", "chain", "p"), F.struct("p", F.col("chain") == INTACT, -F.col("id"))).alias("b"))
    best = best.where(F.col("b.chain") != INTACT).select(*group, "uid", F.col("b.id").alias("id"), F.col("b.p").alias("posterior"))
    best = best.join(alts.select("id", "chain", "restored"), "id").join(named, "uid").drop("id")
    mine = units.join(best, [*group, "uid"])
    return mine.select("doc_id", "source", "kind", *keys, "n", "chain", "restored", "posterior").unionByName(gone)


def garbled(judged: DataFrame) -> DataFrame:
    """Documents with at least one garbled unit."""
    return judged.where(F.col("chain") != INTACT).select("doc_id").distinct()


def restored(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, text, repaired, n_units, n_lost): the garbled documents with every unit that can be put back replaced.

    A document's distinct units are gathered beside it (at most one entry for each run in its own text).
    """
    per = judged.where(F.col("chain") != INTACT).groupBy("doc_id").agg(
        F.collect_list(F.struct("left", "run", "right", "chain", "restored")).alias("units"),
        F.sum("n").alias("n_units"), F.sum(F.when(F.col("chain") == LOST, F.col("n")).otherwise(0)).alias("n_lost"),
    )

    @F.pandas_udf("string")
    def repair(texts: pd.Series, units: pd.Series) -> pd.Series:
        def one(text, found):
            known = {(u["left"], u["run"], u["right"]): u["restored"] for u in found if u["chain"] != LOST}
            out, last = [], 0
            for a, z in runs(text):
                got = known.get((text[max(0, a - 2) : a], text[a:z], text[z : z + 2]))
                if got is not None:
                    out += [text[last:a], got]
                    last = z
            return "".join(out) + text[last:]

        return pd.Series([one(t, u) for t, u in zip(texts, units)], dtype=object)

    return docs.join(per, "doc_id").select("doc_id", "text", repair("text", "units").alias("repaired"), "n_units", "n_lost")
