"""Changed ranges of a git work tree, read by git on the driver (bounded by what has been edited) and handed over as a DataFrame."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MAX_PATHS = 64
HUNK = re.compile(r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@")


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def inside(root: str, path: str) -> str:
    """The path below the root; one that leads out of it is refused."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"{path} is outside the project")
    return full.relative_to(base).as_posix()


def hunks(diff: str) -> dict[str, list[tuple[int, int]]]:
    """Ranges of new lines by path, from a diff without context; a deletion keeps the line it stood at."""
    out: dict[str, list[tuple[int, int]]] = {}
    at = None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            at = None if name == "/dev/null" else name.removeprefix("b/")
            if at is not None:
                out.setdefault(at, [])
        elif at is not None and (m := HUNK.match(line)):
            first, size = int(m[1]), int(m[2] or 1)
            out[at].append((first, first + max(size, 1) - 1))
    return out


def changed_ranges(spark: SparkSession, root: str, base: str = "HEAD", paths: list[str] | None = None) -> DataFrame:
    """(repo, path, first, last, deleted): ranges against `base`, untracked files whole (null range), deleted files marked."""
    if paths is not None:
        if len(paths) > MAX_PATHS:
            raise ValueError(f"at most {MAX_PATHS} paths")
        rows = [(root, inside(root, p), None, None, False) for p in paths]
    else:
        rows = [(root, p, a, z, False) for p, spans in hunks(_git(root, "diff", "--unified=0", "--no-color", "--no-ext-diff", base)).items() for a, z in (spans or [(None, None)])]
        rows += [(root, p, None, None, False) for p in _git(root, "ls-files", "--others", "--exclude-standard").splitlines()]
        rows += [(root, p, None, None, True) for p in _git(root, "diff", "--name-only", "--diff-filter=D", base).splitlines()]
    return spark.createDataFrame(rows, "repo string, path string, first int, last int, deleted boolean")
