"""Schemas of the engine's tables and the closed value sets of its columns (fixed values)."""

from __future__ import annotations

IMPORT = "struct<source:string,names:array<string>,typeOnly:boolean,static:boolean,wildcard:boolean>"
EXPORT = "struct<name:string,source:string,typeOnly:boolean>"
RELATIONSHIPS = "struct<extends:array<string>,implements:array<string>,permits:array<string>>"
SYMBOL = (
    "struct<name:string,kind:string,signature:string,exported:boolean,line:int,container:string,annotations:array<string>,"
    f"modifiers:array<string>,typeParameters:array<string>,relationships:{RELATIONSHIPS}>"
)
#: One row a file.
FILES = (
    "path string, kind string, language string, contentHash string, sizeBytes bigint, lexicalTerms array<string>, "
    f"imports array<{IMPORT}>, exports array<{EXPORT}>, symbols array<{SYMBOL}>, dependencies array<string>, packageName string, degradedReason string"
)
#: What analysing a path can end in.
OUTCOMES = ("indexed", "missing", "ignored", "non-regular", "non-text", "read-error")
SYMBOL_KINDS = ("function", "class", "interface", "type", "enum", "variable", "namespace", "record", "annotation", "constructor", "method", "field", "enum-constant")

RELATIONS = (
    "DECLARES", "ANALYZER_EXPORT_FLAG", "IMPORTS_FILE", "IMPORTS_EXTERNAL", "IMPORT_REFERENCE", "REEXPORTS_FILE", "REEXPORTS_EXTERNAL",
    "REEXPORT_REFERENCE", "JAVA_IMPORTS_TYPE", "JAVA_IMPORTS_STATIC_OWNER", "JAVA_IMPORT_NAME", "EXPORTS_NAME", "DEPENDS_ON_RAW",
    "JAVA_EXTENDS_NAME", "JAVA_IMPLEMENTS_NAME", "JAVA_PERMITS_NAME",
)
RULES = (
    "direct-declares", "direct-analyzer-export-flag", "tsjs-relative-literal", "tsjs-js-family-substitution", "tsjs-extensionless-file",
    "tsjs-extensionless-index", "tsjs-external-bare", "tsjs-external-node-builtin", "java-explicit-top-level-fqn", "java-explicit-static-owner-fqn",
    "java-immediate-container-heuristic", "unresolved-export-name", "unresolved-raw-dependency", "unresolved-java-relationship",
    "unresolved-tsjs-module-reference", "unresolved-java-import",
)
REASONS = (
    "none", "no-candidate", "ambiguous-highest-precedence", "invalid-specifier", "nul-specifier", "query-or-fragment-unsupported",
    "project-root-escape", "absolute-specifier-unsupported", "url-scheme-unsupported", "node-builtin-name-missing", "java-import-flags-missing",
    "java-wildcard-unsupported", "java-static-owner-missing", "java-duplicate-fqn", "java-deep-nested-unsupported",
    "export-symbol-binding-unavailable", "raw-dependency-role-unavailable", "java-relationship-binding-deferred",
)
CANDIDATES_KEPT, EVIDENCE_KEPT = 32, 64
#: Most rows, entries and bytes of a graph's input or output before it is refused.
GRAPH_LIMITS = {
    "pathBytes": 4_096, "stringBytes": 16_384, "files": 100_000, "warnings": 100_000, "dirtyEntries": 100_000, "pendingPaths": 100_000, "symbols": 1_000_000,
    "references": 1_000_000, "externalModules": 250_000, "edges": 1_000_000, "evidence": 1_000_000, "importsPerFile": 10_000, "exportsPerFile": 10_000,
    "symbolsPerFile": 50_000, "dependenciesPerFile": 20_000, "lexicalTermsPerFile": 2_000, "importNames": 1_024, "symbolNestedEntries": 1_024,
    "relationships": 10_000, "retainedEvidence": EVIDENCE_KEPT, "retainedCandidates": CANDIDATES_KEPT, "canonicalInputBytes": 256 * 1024 * 1024,
    "serializedGraphBytes": 256 * 1024 * 1024,
}
