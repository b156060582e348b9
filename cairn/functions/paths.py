"""Path rules: exclusion globs, ordered ignore rules, canonical paths, relative resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directory names that never hold sources.
EXCLUDED_SEGMENTS = (
    ".git", ".pi", ".gradle", "node_modules", "dist", "build", "target", "__pycache__", ".pytest_cache", ".tox",
    ".venv", "venv", ".mypy_cache", ".ruff_cache", "_build", ".cache", ".parcel-cache", ".turbo",
)
SEMANTIC_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".java")
TEXT_PROBE_BYTES = 8192
MAX_PATH_BYTES = 4096


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def in_excluded_segment(path) -> Column:
    return F.arrays_overlap(F.split(_col(path), "/"), F.array(*map(F.lit, EXCLUDED_SEGMENTS)))


def glob_to_regex(pattern: str) -> str:
    """A glob as a Java expression: ``**`` any, ``*`` and ``?`` within a segment, a trailing slash a subtree.

    Patterns without a slash hold at every level, a leading slash binds to the root.
    """
    anchored = pattern.startswith("/")
    body = re.sub(r"^/", "", re.sub(r"^\./", "", pattern))
    subtree = body.endswith("/")
    body += "**" if subtree else ""
    return ("^" if anchored or "/" in body else "(^|.*/)") + _glob_body(body, leading=False) + ("" if subtree else "$")


def _glob_body(body: str, leading: bool) -> str:
    """Wildcards of ``body``; with ``leading``, ``**/`` also stands for no directory at all."""
    tokens = {"**/": "(?:.*/)?" if leading else ".*/", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(tokens.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body))


def excluded_by(path, patterns) -> Column:
    """Built-in segments, or any of the glob ``patterns`` (blank ones and those with ``!`` are ignored)."""
    expressions = [glob_to_regex(p) for p in patterns if p.strip() and not p.startswith("!")]
    out = in_excluded_segment(path)
    return out | _col(path).rlike("|".join(f"(?:{e})" for e in expressions)) if expressions else out


def excludes(patterns):
    """The same as a test of single paths, for notices of changes."""
    expressions = [re.compile(glob_to_regex(p)) for p in patterns if p.strip() and not p.startswith("!")]
    return lambda path: not set(path.split("/")).isdisjoint(EXCLUDED_SEGMENTS) or any(e.search(path) for e in expressions)


def ignore_rules(lines) -> list[dict]:
    """Ordered rules of an ignore file; blank lines and comments are dropped."""
    out = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        anchored, body = body.startswith("/"), body[1:] if body.startswith("/") else body
        only_dir, body = body.endswith("/"), body[:-1] if body.endswith("/") else body
        if body:
            out.append({"negated": negated, "whole": anchored or "/" in body, "only_dir": only_dir, "regex": "^" + _glob_body(body, leading=True) + "$"})
    return out


def ignored_by(path, rules: list[dict]) -> Column:
    """Last matching rule wins for each ancestor and the path itself; below an ignored directory all is ignored."""
    parts = F.filter(F.split(F.translate(_col(path), "\\", "/"), "/"), lambda s: s != "")
    n = F.size(parts)

    def ignored(i: Column) -> Column:
        whole, name = F.array_join(F.slice(parts, 1, i), "/"), F.element_at(parts, i)
        state = F.lit(False)
        for r in rules:
            hit = (whole if r["whole"] else name).rlike(r["regex"])
            state = F.when(hit & (i < n) if r["only_dir"] else hit, F.lit(not r["negated"])).otherwise(state)
        return state

    return F.when(n > 0, F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), ignored)).otherwise(F.lit(False))


def is_text(content) -> Column:
    """No NUL among the first bytes."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(_col(content), 1, TEXT_PROBE_BYTES)), "(..)", "$1 ")) == 0


def is_semantic(path) -> Column:
    return F.lower(_col(path)).rlike("[^/](?:" + "|".join(re.escape(e) for e in SEMANTIC_EXTENSIONS) + ")$")


def is_project_relative(path) -> Column:
    """Neither absolute nor climbing out."""
    path = _col(path)
    return (path != "") & ~path.rlike(r"^(?:/|[A-Za-z]:[\\/])") & ~F.array_contains(F.split(F.translate(path, "\\", "/"), "/"), "..")


def canonical_path(path) -> Column:
    """The path without empty and ``.`` segments, or null if it is not a canonical project path.

    Refused: more than 4096 bytes, control characters, backslashes, drive letters, absolute paths, ``..``, nothing left.
    """
    path = _col(path)
    clean = F.array_join(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), "/")
    bad = (F.octet_length(path) > MAX_PATH_BYTES) | path.rlike(r"[\x00-\x1f\x7f\\]|^/|^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..")
    return F.when(~bad & (clean != ""), clean)


def scanner_path(path) -> Column:
    """The path without leading ``./``, or null: no drive, NUL, backslash, empty, ``.`` or ``..`` segment."""
    path = F.regexp_replace(F.translate(_col(path), "\\", "/"), r"^(?:\./)+", "")
    bad = path.rlike(r"^[A-Za-z]:|\x00") | F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, path)


def resolve_relative(importer, specifier) -> Column:
    """The path that ``specifier`` names from ``importer``'s directory; null if it leaves the root."""
    importer, specifier = _col(importer), _col(specifier)
    parts = F.split(importer, "/")
    start = F.slice(parts, 1, F.size(parts) - 1)

    def walk(at: Column, segment: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
        return F.when(at.isNull(), at).when(segment.isin("", "."), at).when(segment == "..", up).otherwise(F.concat(at, F.array(segment)))

    end = F.aggregate(F.split(specifier, "/"), start, walk)
    return F.when(end.isNotNull(), F.array_join(end, "/"))


def path_collisions(paths: DataFrame, column: str = "path") -> DataFrame:
    """Canonical paths that more than one raw spelling maps to: ``canonical, spellings``."""
    c = paths.select(F.col(column).alias("raw"), canonical_path(column).alias("canonical")).where(F.col("canonical").isNotNull())
    return c.groupBy("canonical").agg(F.count_distinct("raw").alias("spellings")).where(F.col("spellings") > 1)
