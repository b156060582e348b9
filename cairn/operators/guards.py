"""What a graph is built from is checked first: closed values, bounds and collisions, each by a typed failure.

The rules of a row are one projection; collisions and totals are aggregations.  Nothing is collected but the first
failures in path order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import paths as P
from cairn.operators.graph import GraphError

# Kinds of files, languages, and the phase in which each failure is met.
KINDS, LANGUAGES = ("semantic", "lexical"), ("typescript", "javascript", "java", "text")
PHASES = {
    "invalid-snapshot": "validate", "invalid-path": "validate", "path-collision": "canonicalize", "invalid-unicode": "validate", "invalid-enum": "validate", "invalid-hash": "validate",
    "nested-bound-exceeded": "validate", "count-bound-exceeded": "validate", "canonical-input-bound-exceeded": "identify", "serialized-graph-bound-exceeded": "serialize", "identity-collision": "identify",
}
HASH = "^[0-9a-f]{64}$"
LARGEST_INTEGER = (1 << 53) - 1


def _too_long(strings: Column, most: int) -> Column:
    return F.exists(F.coalesce(strings, F.array().cast("array<string>")), lambda s: F.octet_length(s) > most)


def _size(list_: Column) -> Column:
    return F.coalesce(F.size(list_), F.lit(0))


def row_rules(limits: dict[str, int]) -> list[tuple[str, Column]]:
    """(code, condition that breaks it) of one row of a file table."""
    longest = limits["stringBytes"]
    texts = F.array("language", "contentHash", "packageName", "degradedReason")
    inside = [F.transform("imports", lambda i: i["source"]), F.flatten(F.transform("imports", lambda i: F.coalesce(i["names"], F.array().cast("array<string>")))), F.transform("exports", lambda e: e["name"]), F.transform("symbols", lambda s: s["name"]), F.transform("symbols", lambda s: s["signature"])]
    lists = {"lexicalTerms": "lexicalTermsPerFile", "imports": "importsPerFile", "exports": "exportsPerFile", "symbols": "symbolsPerFile", "dependencies": "dependenciesPerFile"}
    nested = lambda s: F.greatest(_size(s["annotations"]), _size(s["modifiers"]), _size(s["typeParameters"])) > limits["symbolNestedEntries"]
    related = lambda s: _size(s["relationships"]["extends"]) + _size(s["relationships"]["implements"]) + _size(s["relationships"]["permits"]) > limits["relationships"]
    return [
        ("invalid-unicode", ~F.is_valid_utf8("path")),
        ("invalid-path", F.col("path").isNull() | (P.canonical_path("path").isNull() & (F.octet_length("path") <= limits["pathBytes"]))),
        ("invalid-snapshot", P.canonical_path("path") != F.col("path")),
        ("nested-bound-exceeded", F.octet_length("path") > limits["pathBytes"]),
        ("invalid-enum", ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)) | F.exists("symbols", lambda s: ~s["kind"].isin(*schema.SYMBOL_KINDS))),
        ("invalid-hash", ~F.coalesce(F.rlike("contentHash", F.lit(HASH)), F.lit(False))),
        ("invalid-snapshot", ~F.coalesce(F.col("sizeBytes").between(0, LARGEST_INTEGER), F.lit(False))),
        ("nested-bound-exceeded", F.greatest(*[(_size(F.col(c)) > limits[k]).cast("int") for c, k in lists.items()]) > 0),
        ("nested-bound-exceeded", F.exists("imports", lambda i: _size(i["names"]) > limits["importNames"]) | F.exists("symbols", lambda s: nested(s) | related(s))),
        ("nested-bound-exceeded", _too_long(texts, longest) | _too_long(F.col("lexicalTerms"), longest) | _too_long(F.col("dependencies"), longest) | _too_long(F.concat(*inside), longest)),
    ]


def failures(files: DataFrame, limits: dict[str, int] = schema.GRAPH_LIMITS) -> DataFrame:
    """``code, path`` of every broken rule of a row, and of every path that several rows have."""
    codes = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in row_rules(limits)]), lambda c: c.isNotNull())
    rows = files.select("path", F.explode(F.array_distinct(codes)).alias("code")).select("code", "path")
    several = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("path-collision").alias("code"), "path")
    return rows.unionByName(several)


def check_input(files: DataFrame, limits: dict[str, int] = schema.GRAPH_LIMITS) -> None:
    """Raises the first failure: of the rows in path order, then of the totals."""
    first = failures(files, limits).orderBy(F.col("path").asc_nulls_first(), "code").limit(1).collect()
    for r in first:
        raise GraphError(r["code"], PHASES[r["code"]], str(r["path"]))
    # The bytes of all canonical rows are summed where they are made.
    row = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(_size(F.col("symbols"))), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*files.columns)))), F.lit(0)).alias("bytes")).first()
    for name in ("files", "symbols"):
        if row[name] > limits[name]:
            raise GraphError("count-bound-exceeded", PHASES["count-bound-exceeded"], f"{row[name]} {name}, {limits[name]} at most")
    if row["bytes"] > limits["canonicalInputBytes"]:
        raise GraphError("canonical-input-bound-exceeded", PHASES["canonical-input-bound-exceeded"], f"{row['bytes']} bytes, {limits['canonicalInputBytes']} at most")


def check_graph(graph, limits: dict[str, int] = schema.GRAPH_LIMITS) -> None:
    """Raises where a built graph has more rows, or more serialised bytes, than it may, or an id twice."""
    total = 0
    tables = {"references": graph.references, "externalModules": graph.externalModules, "edges": graph.edges, "symbols": graph.symbols}
    for name, rows in tables.items():
        got = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))), F.lit(0)).alias("bytes")).first()
        total += got["bytes"]
        if got["ids"] < got["n"]:
            raise GraphError("identity-collision", PHASES["identity-collision"], name)
        if got["n"] > limits[name]:
            raise GraphError("count-bound-exceeded", PHASES["count-bound-exceeded"], f"{got['n']} {name}, {limits[name]} at most")
    if total > limits["serializedGraphBytes"]:
        raise GraphError("serialized-graph-bound-exceeded", PHASES["serialized-graph-bound-exceeded"], f"{total} bytes, {limits['serializedGraphBytes']} at most")
