"""Source trees as file tables: enumeration, admission, reading, hashing, terms and analysis."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import paths as P
from cairn.functions import text as T
from cairn.sources.analyzers import java, script
from cairn.sources.analyzers.lexer import ParseError

MESSAGE_CHARS = 512


# Enumeration.


def git_files(root: str) -> list[str] | None:
    """Tracked and untracked files that git doesn't ignore, or None outside a repository."""
    run = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
    return sorted({p for p in run.stdout.decode("utf-8", "replace").split("\0") if p}) if run.returncode == 0 else None


def git_head(root: str) -> str:
    run = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return run.stdout.strip() if run.returncode == 0 and run.stdout.strip() else "no-head"


def parse_status(raw: str) -> list[tuple[str, bool]]:
    """(path, tracked) from ``git status --porcelain -z``; renames and copies contribute both paths."""
    out, records = [], iter(raw.split("\0"))
    for record in records:
        if len(record) < 4:
            continue
        code, path = record[:2], record[3:]
        out.append((path, code != "??"))
        if "R" in code or "C" in code:
            out.append((next(records, ""), True))
    return [(p, t) for p, t in out if p]


def git_status(root: str) -> list[tuple[str, bool]]:
    run = subprocess.run(["git", "-C", root, "status", "--porcelain=v1", "-z", "--untracked-files=all"], capture_output=True)
    return parse_status(run.stdout.decode("utf-8", "replace")) if run.returncode == 0 else []


def _root(spark: SparkSession, root: str):
    """The tree's file system, and its root as a qualified Hadoop path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def _bytes(fs, path) -> bytes:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """Lines of the root's ignore file; none if it is missing."""
    fs, base = _root(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(base, ".gitignore")
    return _bytes(fs, path).decode("utf-8", "replace").splitlines() if fs.exists(path) else []


CONTENTS = "path string, size long, content binary"


def _hidden(spark: SparkSession, root: str) -> DataFrame:
    """Files that Spark's readers pass over (a name on the way starts with . or _): few, and read by the driver."""
    fs, base = _root(spark, root)
    start, rows = len(base.toUri().getPath().rstrip("/")) + 1, []
    todo = [(base, False)]
    while todo:
        folder, inside = todo.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            hidden = inside or name.startswith((".", "_"))
            if status.isDirectory():
                if name not in P.EXCLUDED_SEGMENTS:
                    todo.append((status.getPath(), hidden))
            elif hidden and status.isFile():
                content = _bytes(fs, status.getPath())
                rows.append((status.getPath().toUri().getPath()[start:], len(content), bytearray(content)))
    return spark.createDataFrame(rows, CONTENTS)


def tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, content`` of all regular files below ``root``; ``content`` is read only where it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = unquote(_root(spark, root)[1].toUri().getPath()).rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z0-9]+:(?://[^/]*)?", "")
    seen = raw.select(F.substring(plain, F.lit(len(prefix) + 1), F.length(plain)).alias("path"), F.col("length").alias("size"), "content")
    return seen.unionByName(_hidden(spark, root))


def admitted(files: DataFrame, excludes=(), ignore=(), listing: list[str] | None = None) -> DataFrame:
    """Files that neither built-in nor configured rules exclude, and that git lists where it does list.

    Filters stand on the path alone, so contents of other files aren't read.
    """
    out = files.where(P.is_project_relative("path") & ~P.excluded_by("path", excludes))
    if listing is not None:
        listed = files.sparkSession.createDataFrame([(p,) for p in listing], "path string")
        return out.join(listed, "path", "left_semi")
    rules = P.ignore_rules(ignore)
    return out.where(~P.ignored_by("path", rules)) if rules else out


# Analysis.

ANALYSIS = f"path string, language string, imports array<{schema.IMPORT}>, exports array<{schema.EXPORT}>, symbols array<{schema.SYMBOL}>, dependencies array<string>, packageName string, problem string"
_OPTIONAL = ("container", "annotations", "modifiers", "typeParameters", "relationships")


def language_of(path: str) -> str:
    end = re.search(r"\.[^./]*$", path)
    end = end[0].lower() if end else ""
    if end == ".java":
        return "java"
    return "javascript" if end in (".js", ".jsx", ".mjs", ".cjs") else "typescript" if end in P.SEMANTIC_EXTENSIONS else "text"


def analyze_source(path: str, text: str) -> dict:
    """Declarations of one source, or the ``problem`` that degrades it to a lexical file."""
    language = language_of(path)
    try:
        found = java.analyze(text) if language == "java" else script.analyze(text)
        problem = None
    except (ParseError, RecursionError) as e:
        found = {"imports": [], "exports": [], "symbols": [], "dependencies": [], "packageName": None}
        problem = re.sub(r"\s+", " ", str(e) or "parse error: nested too deeply")[:MESSAGE_CHARS]
    found["symbols"] = [{**dict.fromkeys(_OPTIONAL), **s} for s in found["symbols"]]
    return {"path": path, "language": language, **found, "problem": problem}


def _analyze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "language", "imports", "exports", "symbols", "dependencies", "packageName", "problem"]
    for batch in batches:
        rows = [analyze_source(p, bytes(c).decode("utf-8", "replace")) for p, c in zip(batch["path"], batch["content"], strict=True)]
        yield pd.DataFrame(rows, columns=names)


def index_files(contents: DataFrame) -> DataFrame:
    """``path, outcome, hash, warning`` and a ``file`` struct (schema.FILES) of each row of (path, content).

    A null content is a file that could not be read.  Only sources reach Python; hashing, the text test and terms
    are column expressions.
    """
    rows = contents.select("path", "content", P.is_text("content").alias("_text"), P.is_semantic("path").alias("_source"))
    sources = rows.where(F.col("_source") & F.col("_text")).select("path", "content").mapInPandas(_analyze, ANALYSIS)
    row = rows.join(sources.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left")
    text = F.decode("content", "UTF-8")
    language = F.coalesce("language", F.lit("text"))
    empty = lambda c: F.coalesce(c, F.array())
    file = F.struct(
        "path", F.when(F.col("_source") & F.col("problem").isNull(), "semantic").otherwise("lexical").alias("kind"), language.alias("language"),
        F.sha2("content", 256).alias("contentHash"), F.octet_length("content").cast("long").alias("sizeBytes"), T.lexical_terms("path", text).alias("lexicalTerms"),
        empty("imports").alias("imports"), empty("exports").alias("exports"), empty("symbols").alias("symbols"), empty("dependencies").alias("dependencies"), "packageName", F.col("problem").alias("degradedReason"),
    )
    unread = F.col("content").isNull()
    warning = F.when(unread, F.struct(F.lit("read-error").alias("code"), F.lit("content is missing").alias("message"))).when(
        F.col("problem").isNotNull(), F.struct(F.lit("parse-error").alias("code"), F.col("problem").alias("message"))
    )
    outcome = F.when(unread, "read-error").when(~F.col("_text"), "non-text").otherwise("indexed")
    return row.select("path", outcome.alias("outcome"), F.sha2("content", 256).alias("hash"), warning.alias("warning"), F.when(outcome == "indexed", file).alias("file"))


def file_table(indexed: DataFrame) -> DataFrame:
    """The indexed rows as a file table."""
    return indexed.where(F.col("outcome") == "indexed").select("file.*")


def changed(contents: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of (path, content) whose content differs from the previous (path, hash): only these need indexing."""
    now = contents.withColumn("_hash", F.sha2("content", 256))
    return now.join(previous.select("path", F.col("hash").alias("_hash")), ["path", "_hash"], "left_anti").drop("_hash")


def build(spark: SparkSession, root: str, excludes=(), use_git: bool = True) -> DataFrame:
    """Indexed rows of a source tree on any file system that Spark reads (git only on a local one)."""
    listing = git_files(root) if use_git else None
    return index_files(admitted(tree(spark, root), excludes, ignore_lines(spark, root) if listing is None else (), listing))
