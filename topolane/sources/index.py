"""Scanned files, language registry, content hash, and the persisted index: versions in directories, one pointer."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topolane import INDEX_VERSION

#: Languages and their extensions, in order of precedence.
REGISTRY: tuple[tuple[str, str], ...] = (
    ("rust", "rs"), ("typescript", "ts tsx mts cts"), ("javascript", "js jsx mjs cjs"), ("python", "py pyw"), ("go", "go"), ("java", "java"),
    ("c", "c h"), ("cpp", "cpp cc cxx hpp hh hxx"), ("cuda", "cu cuh"), ("metal", "metal"), ("csharp", "cs"), ("php", "php module install theme inc"),
    ("ruby", "rb"), ("swift", "swift"), ("kotlin", "kt kts"), ("scala", "scala sc"), ("dart", "dart"), ("lua", "lua"), ("luau", "luau"),
    ("objective_c", "m mm"), ("svelte", "svelte"), ("vue", "vue"), ("astro", "astro"), ("liquid", "liquid"), ("yaml", "yml yaml"),
    ("properties", "properties"), ("twig", "twig"), ("xml", "xml"), ("terraform", "tf tfvars tofu"), ("nix", "nix"), ("r", "r R"),
    ("erlang", "erl hrl escript app"), ("solidity", "sol"), ("pascal", "pas dpr dpk lpr dfm fmx"), ("arkts", "ets"), ("razor", "cshtml razor"),
    ("vbnet", "vb"), ("cfml", "cfc cfm cfs"), ("cobol", "cbl cob cobol cpy"),
)


def supported_languages() -> list[str]:
    return [name for name, _ in REGISTRY]


def language_of(path: Column) -> Column:
    """Language of a path, null if none is registered; `.app.src` is Erlang and conf/routes is Scala."""
    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    out = F.when(path.rlike(r"\.app\.src$"), "erlang").when(path.rlike(r"(^|/)conf/routes$"), "scala")
    for name, exts in REGISTRY:
        out = out.when(ext.isin(*exts.split()), name)
    return out


def is_supported_path(path: str) -> bool:
    ext = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    return path.endswith(".app.src") or path.endswith("conf/routes") or any(ext in exts.split() for _, exts in REGISTRY)


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, bits read as signed. Vectorised over the texts of a batch."""

    @F.pandas_udf("bigint")
    def digest(s: pd.Series) -> pd.Series:
        raw = [None if t is None else t.encode() for t in s]
        out = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
        order = sorted((len(b), i) for i, b in enumerate(raw) if b)
        prime = np.uint64(0x100000001B3)
        # Texts sorted by length: each step takes one byte of all texts that are still going on.
        if order:
            index = np.array([i for _, i in order])
            length = np.array([n for n, _ in order])
            with np.errstate(over="ignore"):
                if length[-1] > 50 * len(order) + 4096:  # few long texts: byte by byte
                    for n, i in order:
                        h = 0xCBF29CE484222325
                        for b in raw[i]:
                            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                        out[i] = h
                else:
                    table = np.zeros((len(order), int(length[-1])), dtype=np.uint8)
                    for row, i in enumerate(index):
                        table[row, : length[row]] = np.frombuffer(raw[i], dtype=np.uint8)
                    h, at = out[index], 0
                    for col in range(int(length[-1])):
                        while length[at] <= col:
                            at += 1
                        h[at:] = (h[at:] ^ table[at:, col]) * prime
                    out[index] = h
        return pd.Series([None if b is None else v for b, v in zip(raw, out.view(np.int64).tolist())], dtype="Int64")

    return digest(text)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, content, content_hash, n_lines) of the supported files below a directory.

    Hidden files are skipped, and what a .gitignore at the root excludes. A supported file that is no UTF-8 fails the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = Path(root).resolve().as_uri().replace("file://", "")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + base.rstrip("/").replace(".", r"\.") + "/", "")
    out = files.select(rel.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\."))
    for rule in ignore_rules(root):
        out = out.where(~F.col("path").rlike(rule))
    out = out.withColumn("language", language_of(F.col("path"))).where("language is not null")
    text = F.when(F.expr("is_valid_utf8(content)"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
    out = out.withColumn("content", text)
    n = F.greatest(F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n", -1)), F.lit(1))
    return out.select("path", "language", "content", fnv1a64(F.col("content")).alias("content_hash"), n.alias("n_lines"))


def ignore_rules(root: str) -> list[str]:
    """Regular expressions of the patterns in the root's .gitignore (without negation)."""
    from topolane.functions.text import glob_regex

    found = []
    where = Path(root) / ".gitignore"
    for line in where.read_text().splitlines() if where.exists() else []:
        rule = line.strip()
        if not rule or rule[0] in "#!":
            continue
        anchored, rule = rule.startswith("/"), rule.strip("/")
        body = glob_regex(rule)[1:-1]
        found.append(("^" if anchored or "/" in rule else "(^|/)") + body + "(/|$)")
    return found


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Old and new scans by key: state is added, removed, changed or unchanged. The latest scan of a key counts."""
    latest = lambda df, name: df.groupBy(*keys).agg(F.max_by("content_hash", F.struct("scanned_at", "file_id")).alias(name))
    both = latest(old, "old_hash").join(latest(new, "new_hash"), list(keys), "full_outer")
    state = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    )
    return both.withColumn("state", state)


def report(state: DataFrame) -> DataFrame:
    """One row: files, changed (with added) and removed."""
    return state.agg(
        F.count(F.when(F.col("state") != "removed", 1)).alias("files"), F.count(F.when(F.col("state").isin("added", "changed"), 1)).alias("changed"),
        F.count(F.when(F.col("state") == "removed", 1)).alias("removed"),
    )


class IndexStore:
    """Versions of an index as Parquet directories below a root; `current.json` names the one that counts.

    A version is written whole before the pointer is replaced in one rename, so a reader never sees half of one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def save(self, **tables: DataFrame) -> str:
        name = uuid.uuid4().hex
        for key, df in tables.items():
            df.write.mode("overwrite").parquet(str(self.root / name / key))
        self.root.mkdir(parents=True, exist_ok=True)
        draft = self.root / f".{name}.json"
        draft.write_text(json.dumps({"version": INDEX_VERSION, "name": name, "tables": sorted(tables)}))
        os.replace(draft, self.root / "current.json")
        return name

    def load(self) -> dict[str, DataFrame] | None:
        """Tables of the current version; None if there is none, it cannot be read, or it has another format."""
        try:
            said = json.loads((self.root / "current.json").read_text())
        except (OSError, ValueError):
            return None
        if said.get("version") != INDEX_VERSION:
            return None
        return {key: self.spark.read.parquet(str(self.root / said["name"] / key)) for key in said["tables"]}
