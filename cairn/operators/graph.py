"""A content-addressed graph of files, symbols, references and external modules, with every relation resolved,
ambiguous or unresolved for a stated reason.

The assembly is a set of selects over ``posexplode``d rows; ids are hashes of canonical JSON computed in the JVM;
edges collapse by id.  The resolver turns each reference into probes, meets them with files in equi-joins and
takes the least precedence.  Lists kept on an edge are cut by ranking within the key, which Spark limits before
it shuffles, next to a plain count, so no list grows with a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import identity as I
from cairn.functions import paths as P
from cairn.operators.materialise import materialise

_NONE = lambda kind="string": F.lit(None).cast(kind)

# Suffixes probed for a module path, and those that stand in for each other.
SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
SUBSTITUTES = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx", ".d.ts"), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts")}
#: Kinds of Java symbols that an import can name.
JAVA_TYPES = ("class", "interface", "enum", "record", "annotation")


# Prefixes and domains of ids are fixed values.


def file_id(path) -> Column:
    return I.domain_id("file:sha256:", "repository-graph/file", F.struct(path.alias("canonicalPath")))


def reference_id(**fields: Column) -> Column:
    return I.domain_id("reference:sha256:", "repository-graph/reference", F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def direct_edge_id(relation: Column, source: Column, target: Column) -> Column:
    return I.domain_id("edge:sha256:", "repository-graph/edge", F.struct(F.lit("direct").alias("descriptorKind"), relation.alias("relation"), source.alias("sourceId"), target.alias("targetId")))


def reference_edge_id(relation: Column, source: Column, reference: Column) -> Column:
    return I.domain_id("edge:sha256:", "repository-graph/edge", F.struct(F.lit("reference").alias("descriptorKind"), reference.alias("referenceId"), relation.alias("relation"), source.alias("sourceId")))


def external_module_id(language: Column, kind: Column, literal: Column) -> Column:
    return I.domain_id("external-module:sha256:", "repository-graph/external-module", F.struct(language.alias("language"), literal.alias("literalSpecifier"), kind.alias("moduleKind")))


def _digest(kind: str, row: Column) -> Column:
    return I.row_digest(F.struct(row.alias("row"), F.lit("repo-map-row/v1").alias("rowDigestSchema"), F.lit(kind).alias("rowKind")))


def _symbol_row(s: Column) -> Column:
    names = ("annotations", "container", "exported", "kind", "line", "modifiers", "name", "relationships", "signature", "typeParameters")
    return F.struct(*[s[n].alias(n) for n in names])


def _with_evidence(rows: DataFrame, kind: str, row: Column) -> DataFrame:
    """``rows`` (fileId, ordinal, nested) plus ``evidenceId``: equal rows of a file count up in recorded order."""
    rows = rows.withColumn("_digest", _digest(kind, row))
    place = Window.partitionBy("fileId", "_digest").orderBy("ordinal", "nested")
    rows = rows.withColumn("_n", F.row_number().over(place))
    descriptor = F.struct(
        F.col("_digest").alias("canonicalRowDigest"), F.col("_n").alias("occurrenceOrdinal"), F.col("nested").alias("recordedNestedOrdinal"),
        F.col("ordinal").alias("recordedRowOrdinal"), F.lit(kind).alias("rowKind"), F.col("fileId").alias("sourceFileId"),
    )
    return rows.withColumn("evidenceId", I.domain_id("evidence:sha256:", "repository-graph/evidence", descriptor)).drop("_digest", "_n")


def _each(files: DataFrame, column: str) -> DataFrame:
    return files.select("fileId", "language", F.posexplode(column).alias("ordinal", "r")).withColumn("nested", _NONE("int"))


@dataclass
class Assembly:
    files: DataFrame
    symbols: DataFrame
    references: DataFrame
    contributions: DataFrame  # of direct and deferred edges: edgeId, relation, sourceId, targetId, referenceId, evidenceId
    work: DataFrame  # workKind, sourceFileId, path, referenceId, language, raw, static, wildcard, evidenceId


def occurrence(order: str, *descriptor: str) -> Column:
    """Equal descriptors count up in recorded order."""
    return F.row_number().over(Window.partitionBy(*descriptor).orderBy(order))


def assemble(files: DataFrame) -> Assembly:
    """Nodes, references, evidence and edges that need no resolving, from a file table."""
    files = files.withColumn("fileId", file_id(F.col("path")))
    tsjs = F.col("language").isin("typescript", "javascript")

    imports = _each(files, "imports")
    imports = _with_evidence(imports, "import", F.struct(*[F.col(f"r.{k}").alias(k) for k in ("names", "source", "static", "typeOnly", "wildcard")]))
    java_import = reference_id(kind=F.lit("java-import-name"), raw=F.col("r.source"), static=F.col("r.static"), wildcard=F.col("r.wildcard"))
    module = lambda raw: reference_id(kind=F.lit("module-specifier"), language=F.col("language"), raw=raw)
    imports = imports.where(tsjs | (F.col("language") == "java")).withColumn("referenceId", F.when(F.col("language") == "java", java_import).otherwise(module(F.col("r.source"))))

    exports = _each(files, "exports")
    exports = _with_evidence(exports, "export", F.struct(*[F.col(f"r.{k}").alias(k) for k in ("name", "source", "typeOnly")]))
    exports = exports.withColumn("referenceId", reference_id(kind=F.lit("export-name"), language=F.col("language"), raw=F.col("r.name")))
    reexports = exports.where(tsjs & F.col("r.source").isNotNull()).withColumn("referenceId", module(F.col("r.source")))

    symbols = _each(files, "symbols")
    symbols = _with_evidence(symbols, "symbol", _symbol_row(F.col("r"))).withColumn("container", F.when(F.col("language") == "java", F.col("r.container")))
    symbols = symbols.withColumn("occurrence", occurrence("ordinal", "fileId", "language", "r.kind", "container", "r.name", "r.signature"))
    descriptor = F.struct(
        F.col("container"), F.col("fileId"), F.col("language"), F.col("r.name").alias("name"), F.col("occurrence").alias("occurrenceOrdinal"),
        F.col("r.signature").alias("signature"), F.col("r.kind").alias("symbolKind"),
    )
    symbols = symbols.withColumn("symbolId", I.domain_id("symbol:sha256:", "repository-graph/symbol", descriptor))

    dependencies = _with_evidence(_each(files, "dependencies"), "dependency", F.col("r"))
    dependencies = dependencies.withColumn("referenceId", reference_id(kind=F.lit("raw-dependency"), language=F.col("language"), raw=F.col("r")))

    related = []
    for kind, relation in (("extends", "JAVA_EXTENDS_NAME"), ("implements", "JAVA_IMPLEMENTS_NAME"), ("permits", "JAVA_PERMITS_NAME")):
        rows = symbols.where(F.col("language") == "java").select("fileId", "symbolId", "r", "ordinal", F.posexplode(f"r.relationships.{kind}").alias("nested", "raw"))
        rows = _with_evidence(rows, "java-relationship", F.struct(F.col("raw"), F.lit(kind).alias("relationship"), _symbol_row(F.col("r")).alias("symbolRow")))
        related.append(rows.withColumn("relation", F.lit(relation)).withColumn("relationship", F.lit(kind)))
    related = reduce(DataFrame.unionByName, related).withColumn("referenceId", reference_id(kind=F.lit("java-relationship-name"), raw=F.col("raw"), relationship=F.col("relationship")))

    def direct(rows: DataFrame, relation: str) -> DataFrame:
        edge = direct_edge_id(F.lit(relation), F.col("fileId"), F.col("symbolId"))
        return rows.select(edge.alias("edgeId"), F.lit(relation).alias("relation"), F.col("fileId").alias("sourceId"), F.col("symbolId").alias("targetId"), _NONE().alias("referenceId"), "evidenceId")

    def deferred(rows: DataFrame, relation: Column, source: str) -> DataFrame:
        edge = reference_edge_id(relation, F.col(source), F.col("referenceId"))
        return rows.select(edge.alias("edgeId"), relation.alias("relation"), F.col(source).alias("sourceId"), _NONE().alias("targetId"), "referenceId", "evidenceId")

    contributions = [
        direct(symbols, "DECLARES"), direct(symbols.where("r.exported"), "ANALYZER_EXPORT_FLAG"), deferred(exports, F.lit("EXPORTS_NAME"), "fileId"),
        deferred(dependencies, F.lit("DEPENDS_ON_RAW"), "fileId"), deferred(related, F.col("relation"), "symbolId"),
    ]

    def work(rows: DataFrame, kind: Column) -> DataFrame:
        return rows.select(kind.alias("workKind"), F.col("fileId").alias("sourceFileId"), "referenceId", "language", F.col("r.source").alias("raw"), _flag(rows, "static"), _flag(rows, "wildcard"), "evidenceId")

    def _flag(rows: DataFrame, name: str) -> Column:
        return (F.col(f"r.{name}") if name in rows.schema["r"].dataType.names else _NONE("boolean")).alias(name)

    todo = work(imports, F.when(F.col("language") == "java", "java-import").otherwise("tsjs-import")).unionByName(work(reexports, F.lit("tsjs-reexport")))
    todo = todo.join(files.select(F.col("fileId").alias("sourceFileId"), "path"), "sourceFileId")

    def refs(rows: DataFrame, kind: Column, raw: str, **more: Column) -> DataFrame:
        extra = {k: more.get(k, _NONE("boolean" if k in ("static", "wildcard") else "string")) for k in ("language", "relationship", "static", "wildcard")}
        return rows.select(F.col("referenceId").alias("id"), kind.alias("kind"), F.col(raw).alias("raw"), *[v.alias(k) for k, v in extra.items()])

    language = F.col("language")
    references = [
        refs(imports.where(tsjs), F.lit("module-specifier"), "r.source", language=language), refs(reexports, F.lit("module-specifier"), "r.source", language=language),
        refs(imports.where(~tsjs), F.lit("java-import-name"), "r.source", static=F.col("r.static"), wildcard=F.col("r.wildcard")),
        refs(exports, F.lit("export-name"), "r.name", language=language), refs(dependencies, F.lit("raw-dependency"), "r", language=language),
        refs(related, F.lit("java-relationship-name"), "raw", relationship=F.col("relationship")),
    ]
    nodes = files.select(F.col("fileId").alias("id"), "path", "language", "kind", "contentHash", "sizeBytes", "packageName", "degradedReason")
    symbol_nodes = symbols.select(F.col("symbolId").alias("id"), "fileId", "language", F.col("r.kind").alias("symbolKind"), "container", F.col("r.name").alias("name"), F.col("r.signature").alias("signature"), F.col("occurrence").alias("occurrenceOrdinal"), "ordinal")
    return Assembly(nodes, symbol_nodes, reduce(DataFrame.unionByName, references).dropDuplicates(["id"]), reduce(DataFrame.unionByName, contributions), todo)


# Resolution.  A probe is (key columns, candidate path, precedence, rule); a candidate is a probe that met a file.


def literal_reason(raw: Column) -> Column:
    """Why a module specifier can't be looked at, or null; the first that holds."""
    return (
        F.when(raw == "", "invalid-specifier").when(raw.contains("\x00"), "nul-specifier").when(raw.rlike("[?#]"), "query-or-fragment-unsupported")
        .when(raw.rlike(r"^(?:/|\\|[A-Za-z]:[\\/])"), "absolute-specifier-unsupported").when(raw.contains("\\"), "invalid-specifier")
        .when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~raw.startswith("node:"), "url-scheme-unsupported").when(raw == "node:", "node-builtin-name-missing")
    )


def is_relative(raw: Column) -> Column:
    return raw.startswith("./") | raw.startswith("../")


def probes(base: Column, literal: Column) -> Column:
    """All paths that a relative specifier may mean, as structs (path, precedence, rule)."""
    probe = lambda path, p, rule: F.struct(path.alias("path"), F.lit(p).alias("precedence"), F.lit(rule).alias("rule"))
    name = F.substring_index(base, "/", -1)
    directory = literal.endswith("/")
    plain = (name != "") & ~name.contains(".")
    out = [F.when(~directory, probe(base, 0, "tsjs-relative-literal"))]
    for suffix, others in SUBSTITUTES.items():
        stem = F.substring(base, F.lit(1), F.length(base) - len(suffix))
        out += [F.when(~directory & base.endswith(suffix), probe(F.concat(stem, F.lit(o)), 100 + i, "tsjs-js-family-substitution")) for i, o in enumerate(others)]
    out += [F.when(~directory & plain, probe(F.concat(base, F.lit(s)), 200 + i, "tsjs-extensionless-file")) for i, s in enumerate(SUFFIXES)]
    index = F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("/"))), F.lit("index"))
    out += [F.when(directory | plain, probe(F.concat(index, F.lit(s)), 300 + i, "tsjs-extensionless-index")) for i, s in enumerate(SUFFIXES)]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def relative_candidates(specifiers: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, id, precedence, rule`` of files (id, path) that relative specifiers (keys, path, raw) may mean.

    A substituted suffix counts only where the literal path is absent.
    """
    base = P.resolve_relative("path", "raw")
    asked = specifiers.select(*keys, F.explode(probes(base, F.col("raw"))).alias("p")).select(*keys, F.col("p.path").alias("_probe"), "p.precedence", "p.rule")
    met = asked.join(files.select(F.col("path").alias("_probe"), "id"), "_probe").drop("_probe")
    # A key has no more rows than probes.
    best = F.min("precedence").over(Window.partitionBy(*keys))
    return met.withColumn("_best", best).where((F.col("rule") != "tsjs-js-family-substitution") | (F.col("_best") != 0)).drop("_best")


def decide(candidates: DataFrame, keys: list[str], keep: int = schema.CANDIDATES_KEPT) -> DataFrame:
    """One row a key: the winner of least precedence if it is one target, the first candidates and how many more.

    ``status`` is exact (precedence 0), heuristic or unresolved; an unresolved row's ``tie`` is its precedence.
    """
    distinct = materialise(candidates.select(*keys, "precedence", "rule", "id").distinct())
    # Precedences are reduced first, then keys: a key of any number of candidates is combined before each shuffle.
    ranks = distinct.groupBy(*keys, "precedence").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("rule").alias("rule"), F.count("*").alias("n"))
    best = ranks.groupBy(*keys).agg(F.min(F.struct("precedence", "lo", "hi", "rule")).alias("_b"), F.sum("n").alias("_n"))
    place = Window.partitionBy(*keys).orderBy("precedence", "rule", "id")
    first = distinct.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= keep)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("precedence", "rule", "id"))).alias("candidates"))
    one = F.col("_b.lo") == F.col("_b.hi")
    return best.join(first, keys).select(
        *keys, F.when(~one, "unresolved").when(F.col("_b.precedence") == 0, "exact").otherwise("heuristic").alias("status"), F.when(one, F.col("_b.rule")).alias("rule"),
        F.when(one, F.col("_b.lo")).alias("targetId"), F.when(~one, F.col("_b.precedence")).alias("tie"), "candidates", (F.col("_n") - F.size("candidates")).alias("omittedCandidateCount"),
    )


CANDIDATES = "array<struct<precedence:int,rule:string,id:string>>"


def _resolution(status, rule, reason, target=None, candidates=None, omitted=None) -> list[Column]:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return [
        as_col(status).alias("status"), as_col(rule).alias("rule"), as_col(reason).alias("reason"), (_NONE() if target is None else target).alias("targetId"),
        (F.array() if candidates is None else F.coalesce(candidates, F.array())).cast(CANDIDATES).alias("candidates"), F.coalesce(F.lit(0) if omitted is None else omitted, F.lit(0)).cast("long").alias("omittedCandidateCount"),
    ]


def resolve_modules(work: DataFrame, files: DataFrame) -> DataFrame:
    """``sourceFileId, referenceId, workKind, relation`` and the resolution of TS/JS imports and re-exports."""
    key = ["sourceFileId", "referenceId", "workKind"]
    items = work.select(*key, "path", "raw", "language").dropDuplicates(key).withColumn("_why", literal_reason(F.col("raw")))
    into = lambda kind: F.when(F.col("workKind") == "tsjs-import", F.lit({"ref": "IMPORT_REFERENCE", "file": "IMPORTS_FILE", "ext": "IMPORTS_EXTERNAL"}[kind])).otherwise(F.lit({"ref": "REEXPORT_REFERENCE", "file": "REEXPORTS_FILE", "ext": "REEXPORTS_EXTERNAL"}[kind])).alias("relation")
    unresolved = "unresolved-tsjs-module-reference"

    refused = items.where(F.col("_why").isNotNull()).select(*key, into("ref"), *_resolution("unresolved", unresolved, F.col("_why")))
    relative = items.where(F.col("_why").isNull() & is_relative(F.col("raw"))).withColumn("_base", P.resolve_relative("path", "raw"))
    escaped = relative.where(F.col("_base").isNull()).select(*key, into("ref"), *_resolution("unresolved", unresolved, "project-root-escape"))
    inside = relative.where(F.col("_base").isNotNull())
    decided = inside.select(*key).join(decide(relative_candidates(inside, files, key), key), key, "left")
    rule = F.coalesce("rule", F.lit(unresolved))
    reason = F.when(F.col("status").isNull(), "no-candidate").when(F.col("status") == "unresolved", "ambiguous-highest-precedence").otherwise("none")
    found = decided.select(*key, into("file"), *_resolution(F.coalesce("status", F.lit("unresolved")), rule, reason, F.col("targetId"), F.col("candidates"), F.col("omittedCandidateCount")))

    outside = items.where(F.col("_why").isNull() & ~is_relative(F.col("raw")))
    builtin = F.col("raw").startswith("node:")
    outside = outside.withColumn("_kind", F.when(builtin, "node-builtin").otherwise("bare")).withColumn("_rule", F.when(builtin, "tsjs-external-node-builtin").otherwise("tsjs-external-bare"))
    outside = outside.withColumn("_id", external_module_id(F.col("language"), F.col("_kind"), F.col("raw")))
    one = F.array(F.struct(F.lit(0).alias("precedence"), F.col("_rule").alias("rule"), F.col("_id").alias("id")))
    external = outside.select(*key, into("ext"), *_resolution("exact", F.col("_rule"), "none", F.col("_id"), one))
    return refused.unionByName(escaped).unionByName(found).unionByName(external)


def external_modules(work: DataFrame) -> DataFrame:
    """``id, language, moduleKind, literalSpecifier`` of all specifiers that name no file."""
    raw = F.col("raw")
    named = work.where((F.col("workKind") != "java-import") & literal_reason(raw).isNull() & ~is_relative(raw))
    kind = F.when(raw.startswith("node:"), "node-builtin").otherwise("bare")
    return named.select(external_module_id(F.col("language"), kind, raw).alias("id"), "language", kind.alias("moduleKind"), raw.alias("literalSpecifier")).dropDuplicates(["id"])


def java_index(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fqn, id) of top-level types, (package, spelling, id) of types one container deep, and packages."""
    able = files.where((F.col("language") == "java") & (F.col("kind") == "semantic") & F.col("degradedReason").isNull())
    able = able.select(F.col("id").alias("fileId"), F.coalesce("packageName", F.lit("")).alias("package"))
    types = symbols.where(F.col("symbolKind").isin(*JAVA_TYPES)).select("fileId", "name", "container").join(able, "fileId")
    fqn = F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name"))
    top = types.where(F.col("container").isNull()).select(fqn.alias("fqn"), F.col("fileId").alias("id")).distinct()
    inner = types.where(F.col("container").isNotNull()).select("package", F.concat_ws(".", "container", "name").alias("spelling"), F.col("fileId").alias("id")).distinct()
    return top, inner, able.select("package").distinct()


def resolve_java(work: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """As ``resolve_modules``, for Java imports; the prefix test against all packages is an equi-join on prefixes."""
    key = ["sourceFileId", "referenceId", "workKind"]
    top, inner, packages = java_index(files, symbols)
    items = work.where(F.col("workKind") == "java-import").select(*key, "raw", "static", "wildcard").dropDuplicates(key)
    parts = F.split("raw", r"\.")
    why = (
        F.when(F.col("static").isNull() | F.col("wildcard").isNull(), "java-import-flags-missing").when(F.col("wildcard"), "java-wildcard-unsupported")
        .when((F.col("raw") == "") | F.exists(parts, lambda s: s == ""), "invalid-specifier").when(F.col("raw").contains("\x00"), "nul-specifier")
    )
    items = items.withColumn("_why", why)
    refs = items.where(F.col("_why").isNull()).select("referenceId", "raw", "static").distinct()
    asked = F.when(F.col("static"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).otherwise(F.col("raw"))
    rule = F.when(F.col("static"), "java-explicit-static-owner-fqn").otherwise("java-explicit-top-level-fqn")
    exact = refs.select("referenceId", asked.alias("fqn"), rule.alias("rule")).join(top, "fqn").select("referenceId", "id", F.lit(0).alias("precedence"), "rule")
    rest = refs.where(~F.col("static")).join(exact.select("referenceId").distinct(), "referenceId", "left_anti")
    n = F.size(parts)
    split = F.explode(F.sequence(F.lit(0), n - 1)).alias("i")
    prefixes = rest.select("referenceId", parts.alias("_parts"), split).select("referenceId", F.array_join(F.slice("_parts", 1, F.col("i")), ".").alias("package"), F.array_join(F.slice("_parts", F.col("i") + 1, F.size("_parts")), ".").alias("spelling"), (F.size("_parts") - F.col("i")).alias("left"))
    prefixes = prefixes.join(packages, "package", "left_semi")
    deep = prefixes.groupBy("referenceId").agg(F.bool_or(F.col("left") > 2).alias("deep"))
    nested = prefixes.where(F.col("left") == 2).join(inner, ["package", "spelling"]).select("referenceId", "id", F.lit(100).alias("precedence"), F.lit("java-immediate-container-heuristic").alias("rule"))
    decided = decide(exact.unionByName(nested), ["referenceId"])
    out = items.join(decided, "referenceId", "left").join(deep, "referenceId", "left")
    reason = (
        F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("status").isNull() & F.col("static"), "java-static-owner-missing")
        .when(F.col("status").isNull() & F.coalesce("deep", F.lit(False)), "java-deep-nested-unsupported").when(F.col("status").isNull(), "no-candidate")
        .when((F.col("status") == "unresolved") & (F.col("tie") == 0), "java-duplicate-fqn").when(F.col("status") == "unresolved", "ambiguous-highest-precedence").otherwise("none")
    )
    relation = F.when(F.col("_why").isNotNull(), "JAVA_IMPORT_NAME").when(F.col("static"), "JAVA_IMPORTS_STATIC_OWNER").otherwise("JAVA_IMPORTS_TYPE")
    return out.select(*key, relation.alias("relation"), *_resolution(F.coalesce("status", F.lit("unresolved")), F.coalesce("rule", F.lit("unresolved-java-import")), reason, F.col("targetId"), F.col("candidates"), F.col("omittedCandidateCount")))


def fixed_resolution(relation: Column) -> list[Column]:
    """The resolution of relations that need none."""
    status = F.when(relation.isin("DECLARES", "ANALYZER_EXPORT_FLAG"), "exact").otherwise("unresolved")
    rule = F.when(relation == "DECLARES", "direct-declares").when(relation == "ANALYZER_EXPORT_FLAG", "direct-analyzer-export-flag").when(relation == "EXPORTS_NAME", "unresolved-export-name").when(relation == "DEPENDS_ON_RAW", "unresolved-raw-dependency").otherwise("unresolved-java-relationship")
    reason = F.when(status == "exact", "none").when(relation == "EXPORTS_NAME", "export-symbol-binding-unavailable").when(relation == "DEPENDS_ON_RAW", "raw-dependency-role-unavailable").otherwise("java-relationship-binding-deferred")
    return [status.alias("status"), rule.alias("rule"), reason.alias("reason")]


def collapse(contributions: DataFrame, keys: list[str], keep: int = schema.EVIDENCE_KEPT) -> DataFrame:
    """``keys, evidence, evidenceCount, omittedEvidenceCount``: the smallest evidence ids of each edge and the rest's number."""
    counts = contributions.groupBy(*keys).agg(F.count("*").alias("evidenceCount"))
    place = Window.partitionBy(*keys).orderBy("evidenceId")
    first = contributions.select(*keys, "evidenceId").withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= keep)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list("evidenceId")).alias("evidence"))
    return counts.join(first, keys).withColumn("omittedEvidenceCount", F.col("evidenceCount") - F.size("evidence"))


@dataclass
class Graph:
    files: DataFrame
    symbols: DataFrame
    externalModules: DataFrame
    references: DataFrame
    edges: DataFrame


class GraphError(ValueError):
    """A build that was refused: ``code`` and ``phase`` say why."""

    def __init__(self, code: str, phase: str, detail: str = ""):
        super().__init__(f"{code} ({phase}) {detail}".strip())
        self.code, self.phase = code, phase


def build_graph(files: DataFrame) -> Graph:
    """The graph of a file table whose paths are canonical; see ``violations`` for the checks."""
    a = assemble(files)
    # Each table of the assembly is computed once; the resolver reads the work items several times.
    a = Assembly(*[materialise(x) for x in (a.files, a.symbols, a.references, a.contributions, a.work)])
    ids = a.files.select("id", "path")
    modules = resolve_modules(a.work.where(F.col("workKind") != "java-import"), ids)
    resolved = materialise(modules.unionByName(resolve_java(a.work, a.files, a.symbols)))
    todo = a.work.select("sourceFileId", "referenceId", "workKind", "evidenceId").join(resolved, ["sourceFileId", "referenceId", "workKind"])
    todo = todo.withColumn("edgeId", reference_edge_id(F.col("relation"), F.col("sourceFileId"), F.col("referenceId")))
    facts = ["edgeId", "relation", "sourceId", "targetId", "referenceId", "status", "rule", "reason", "candidates", "omittedCandidateCount"]
    later = todo.select(F.col("sourceFileId").alias("sourceId"), *[c for c in facts if c != "sourceId"])
    ready = a.contributions.select("edgeId", "relation", "sourceId", "targetId", "referenceId", *fixed_resolution(F.col("relation")), F.array().cast(CANDIDATES).alias("candidates"), F.lit(0).cast("long").alias("omittedCandidateCount"))
    described = ready.unionByName(later).dropDuplicates(["edgeId"])
    evidence = a.contributions.select("edgeId", "evidenceId").unionByName(todo.select("edgeId", "evidenceId"))
    edges = described.join(collapse(evidence, ["edgeId"]), "edgeId").withColumnRenamed("edgeId", "id")
    edges = edges.orderBy("sourceId", "relation", F.col("referenceId").asc_nulls_first(), F.col("targetId").asc_nulls_first(), "id")
    return Graph(a.files.orderBy("id"), a.symbols.orderBy("id"), external_modules(a.work).orderBy("id"), a.references.orderBy("id"), edges)


def missing_ends(edges: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """The rows of ``edges`` whose ``end`` is set but not the ``id`` of a node."""
    ids = nodes.select(F.col("id").alias("_end"))
    return edges.where(F.col(end).isNotNull()).join(ids, F.col(end) == F.col("_end"), "left_anti")


def violations(graph: Graph) -> DataFrame:
    """``check, id`` of all rows that break an integrity rule: a good graph has none."""
    nodes = graph.files.select("id").union(graph.symbols.select("id")).union(graph.externalModules.select("id"))
    edges = graph.edges
    out = [
        missing_ends(edges, "sourceId", nodes).select(F.lit("source-missing").alias("check"), "id"),
        missing_ends(edges, "targetId", nodes).select(F.lit("target-missing"), "id"),
        missing_ends(edges, "referenceId", graph.references).select(F.lit("reference-missing"), "id"),
        nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate-id"), "id"),
        edges.where(~F.col("relation").isin(*schema.RELATIONS) | ~F.col("rule").isin(*schema.RULES) | ~F.col("reason").isin(*schema.REASONS)).select(F.lit("unknown-code"), "id"),
        edges.where((F.col("status") != "unresolved") & F.col("targetId").isNull()).select(F.lit("resolved-without-target"), "id"),
    ]
    return reduce(DataFrame.union, out)
