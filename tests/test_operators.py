"""Search, scan, graph, state, merge and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import identity as I
from cairn.functions import text as T
from cairn.operators import graph as G
from cairn.operators import guards
from cairn.operators import merge as M
from cairn.operators import scan as L
from cairn.operators import search as S
from cairn.operators import state as ST
from cairn.operators.ordered import running
from cairn.sources.generations import Store
from cairn.streaming import changes as C


def file(path, **more):
    row = {"path": path, "kind": "semantic", "language": "typescript", "contentHash": "a" * 64, "sizeBytes": 1, "lexicalTerms": [], "imports": [], "exports": [], "symbols": [], "dependencies": [], "packageName": None, "degradedReason": None}
    return {**row, **more}


def imp(source, names=(), static=None, wildcard=None):
    return {"source": source, "names": list(names), "typeOnly": False, "static": static, "wildcard": wildcard}


def sym(name, kind="function", container=None, exported=False, relationships=None, signature=None):
    return {"name": name, "kind": kind, "signature": signature or f"{kind} {name}", "exported": exported, "line": 1, "container": container, "annotations": None, "modifiers": None, "typeParameters": None, "relationships": relationships}


def table(spark, rows):
    return spark.createDataFrame(rows, schema.FILES)


# Search


def test_scores_of_a_large_tree(spark):
    """Published scores of three files of a tree of 5,000 generated ones."""
    names = lambda k: [f"syntheticSymbol{k}", *([f"BATCH_MARKER_{k}"] if k < 64 else []), *(["UPDATED_ONE_MARKER"] if k == 4999 else [])]

    def row(k):
        path = f"src/file-{k:05d}.ts"
        text = f"export function syntheticSymbol{k}() {{ return {k}; }}\n"
        text += f"export const BATCH_MARKER_{k} = true;\n" if k < 64 else "export const UPDATED_ONE_MARKER = true;\n" if k == 4999 else "\n"
        symbols = [sym(names(k)[0], exported=True, signature=f"function {names(k)[0]}()")] + [sym(n, "variable", exported=True, signature=f"const {n}") for n in names(k)[1:]]
        return file(path, symbols=symbols, exports=[{"name": n, "source": None, "typeOnly": False} for n in names(k)], lexicalTerms=None), text

    import re

    rows = []
    for k in range(5000):
        f, text = row(k)
        f["lexicalTerms"] = list(dict.fromkeys(re.findall(r"[\w$-]{2,}", (f["path"] + " " + text).lower())))
        rows.append(f)
    index = S.build_index(table(spark, rows))
    got = {r.path: r.score for r in S.search(index, "BATCH_MARKER_99", limit=20).collect()}
    for path, score in {"src/file-00019.ts": 8.630246664257141, "src/file-00009.ts": 8.630244594528328, "src/file-00010.ts": 8.616427503921678}.items():
        assert got[path] == pytest.approx(score, abs=1e-3)
    index.postings.unpersist()


def test_ranking_and_reasons(spark):
    files = table(
        spark,
        [
            file("src/parser.ts", symbols=[sym("parseHeader", exported=True)], exports=[{"name": "parseHeader", "source": None, "typeOnly": False}], lexicalTerms=["parseheader"]),
            file("vendor/parser.ts", symbols=[sym("parseHeader")], lexicalTerms=["parseheader"]),
            file("src/parser.min.js", language="javascript", lexicalTerms=["parseheader"]),
            file("com/acme/Tool.java", language="java", packageName="com.acme", symbols=[sym("Tool", "class")]),
            file("b.ts", lexicalTerms=["same"]), file("a.ts", lexicalTerms=["same"]),
        ],
    )
    index = S.build_index(files)
    got = S.search(index, "parseHeader").collect()
    assert [r.path for r in got] == ["src/parser.ts", "vendor/parser.ts", "src/parser.min.js"]
    assert got[0].matchReasons == ["exact symbol: parseHeader", "exact export: parseHeader", "matched terms: parseheader"] and got[0].matchedSymbols == ["parseHeader"]
    assert "de-boosted vendor" in got[1].matchReasons and "de-boosted minified" in got[2].matchReasons
    assert S.search(index, "src/parser.min.js").first().path == "src/parser.min.js"
    assert "qualified path: com.acme.tool" in S.search(index, "com.acme.Tool").first().matchReasons
    assert [r.path for r in S.search(index, "same").collect()] == ["a.ts", "b.ts"]
    assert S.search(index, "parseHeadr").first().path == "src/parser.ts" and S.search(index, "parseHea", limit=1).count() == 1
    assert S.search(index, "  ").count() == 0 and S.search(S.build_index(files.limit(0)), "x").count() == 0
    with pytest.raises(ValueError):
        S.search(index, "x", limit=0)


# Scan


def test_scan(spark):
    rows = [("src/parse_header.py", "def parse_header(x):\n    return HttpClient\n"), ("z/notes.md", "The parse_header function\nuses HttpClient a lot\nand more"), ("a/none.txt", "nothing"), ("parse_header", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = L.scan(files, "parse_header")
    assert [(r.path, r.evidence) for r in got.results.collect()] == [("src/parse_header.py", "source"), ("parse_header", "warming"), ("z/notes.md", "source")]
    assert got.results.first().excerpt.startswith("def parse_header(x):") and got.stats["terminalReason"] == "matched"
    assert L.scan(files, "zzz").stats["terminalReason"] == "no-match"
    early = L.scan(files, "parse_header HttpClient")
    assert early.stats["terminalReason"] == "matched" and early.read.where("strong").count() == 2
    small = L.scan(files, "parse_header", limits=L.Limits().lowered(file_bytes=10))
    assert small.stats["terminalReason"] == "file-prefix-cap"
    assert L.scan(files, "parse_header", limits=L.Limits().lowered(files=2)).stats["terminalReason"] == "file-count-cap"
    assert L.scan(files, "parse_header", limits=L.Limits().lowered(paths=2)).stats["terminalReason"] == "enumeration-path-cap"
    assert L.scan(files, "parse_header", limits=L.Limits().lowered(path_bytes=20)).stats["terminalReason"] == "enumeration-byte-cap"
    assert L.scan(files.limit(0), "x").results.count() == 0


def test_excerpts():
    assert L.excerpt("one\ntwo match\nthree\nfour", 8, 5, 100) == "one\ntwo match\nthree"
    long_ = "é" * 300 + "match" + "ü" * 300
    cut = L.excerpt(long_, 300, 5, 50)
    assert "match" in cut and len(cut.encode()) <= 50
    assert L.utf8_prefix("aé", 2) == "a"


def test_strong_names_are_whole_and_two(spark):
    names = ["foo_bar", "baz.qux", "foo"]
    rows = [("call foo_bar and Baz.qux", 2), ("xfoo_bar foo_bar.x baz.qux", 1), ("foo_bar foo_bar", 1), ("", 0), (None, 0), ("(foo)foo_bar", 2)]
    got = spark.createDataFrame(rows, "t string, n int").select("n", T.names_in("t", names).alias("got")).collect()
    assert all(r.n == r.got for r in got)


@pytest.mark.parametrize(
    ("facts", "reason"),
    [({}, "matched"), ({"results": 0}, "no-match"), ({"truncated": True}, "file-prefix-cap"), ({"spent": 10}, "source-byte-cap"), ({"files": 5}, "file-count-cap"), ({"listed": {"n": 8, "b": 1}}, "enumeration-path-cap"),
     ({"listed": {"n": 3, "b": 99}}, "enumeration-byte-cap"), ({"listed": {"n": 8, "b": 99}, "early": True}, "matched"), ({"late": "source", "early": True}, "source-timeout"), ({"late": "enumeration"}, "enumeration-timeout"), ({"cancelled": True, "late": "source"}, "cancelled")],
)
def test_every_end_of_a_scan(facts, reason):
    all_ = {"listed": {"n": 6, "b": 6}, "files": 1, "spent": 1, "truncated": False, "early": False, "results": 1} | facts
    assert L.terminal(limits=L.Limits(paths=7, path_bytes=50, files=5, source_bytes=10), **all_) == (reason, L.ENDS[reason])


def test_what_a_scan_shows_is_checked(spark):
    kinds = "path string, score double, evidence string, excerpt string"
    good = [("a/b.ts", 5e9, "source", "é" * 400), ("c.md", 1.0, "warming", "")]
    show = lambda rows, end=("matched", "complete"), known=None: (lambda r: ({x.path: x for x in r[0].collect()}, r[1]))(L.sanitised(spark.createDataFrame(rows, kinds), end, known))
    rows, end = show(good)
    assert end == ("matched", "complete") and set(rows) == {"a/b.ts", "c.md"}
    assert rows["a/b.ts"].score == L.SCORE_BOUND and len(rows["a/b.ts"].excerpt.encode()) == L.SHOWN_EXCERPT_BYTES
    assert show(good, ("source-byte-cap", "source"))[0] and show(good, ("cancelled", "cancelled")) == ({}, ("cancelled", "cancelled"))
    known = spark.createDataFrame([("a/b.ts",)], "path string")
    for rows, end, of in (
        ([*good, ("../x", 1.0, "source", "")], ("matched", "complete"), None), ([("a", float("nan"), "source", "")], ("matched", "complete"), None), ([("a", 1.0, "guess", "")], ("matched", "complete"), None),
        ([("a", 1.0, "source", None)], ("matched", "complete"), None), (good, ("no-match", "complete"), None), (good, ("matched", "source"), None), (good, ("why", "complete"), None), (good, ("matched", "complete"), known),
        (good + good[:1], ("matched", "complete"), None), ([(f"p{k}", 1.0, "source", "") for k in range(21)], ("matched", "complete"), None),
    ):
        assert show(rows, end, of) == ({}, ("invalid-scanner-output", "output")), (rows, end)


def test_running_totals(spark):
    rows = [(i % 7, i, i * i) for i in range(500)]
    got = running(spark.createDataFrame(rows, "k long, i long, v long").repartition(7), ["k", "i"], {"place": "1L", "total": "v"}, 5).collect()
    total = 0
    want = {}
    for place, (_, i, v) in enumerate(sorted(rows), 1):
        total += v
        want[i] = (place, total)
    assert {r.i: (r.place, r.total) for r in got} == want


# Graph


def resolve(spark, importer, specifiers, paths):
    files = [file(p) for p in paths if p != importer] + [file(importer, imports=[imp(s) for s in specifiers])]
    g = G.build_graph(table(spark, files))
    names = {r.id: r.path for r in g.files.collect()}
    refs = {r.id: r.raw for r in g.references.collect()}
    out = {}
    for e in g.edges.where("relation LIKE 'IMPORT%'").collect():
        out[refs[e.referenceId]] = (e.relation, e.status, e.rule, e.reason, [c.precedence for c in e.candidates], names.get(e.targetId))
    return out


def test_module_specifiers(spark):
    paths = ["src/main.ts", "src/exact", "src/exact.ts", "src/exact/index.ts", "src/replace.ts", "src/replace.tsx", "src/module.ts", "src/module.js", "src/module/index.ts", "src/folder/index.tsx", "up.mts", "src/both.ts"]
    u = "unresolved-tsjs-module-reference"
    cases = {
        "./exact": ("IMPORTS_FILE", "exact", "tsjs-relative-literal", "none", [0, 200, 300], "src/exact"),
        "./replace.js": ("IMPORTS_FILE", "heuristic", "tsjs-js-family-substitution", "none", [100, 101], "src/replace.ts"),
        "./module": ("IMPORTS_FILE", "heuristic", "tsjs-extensionless-file", "none", [200, 204, 300], "src/module.ts"),
        "./folder/": ("IMPORTS_FILE", "heuristic", "tsjs-extensionless-index", "none", [301], "src/folder/index.tsx"),
        "../up": ("IMPORTS_FILE", "heuristic", "tsjs-extensionless-file", "none", [202], "up.mts"),
        "./both.ts": ("IMPORTS_FILE", "exact", "tsjs-relative-literal", "none", [0], "src/both.ts"),
        "./nope": ("IMPORTS_FILE", "unresolved", u, "no-candidate", [], None), "../../escape": ("IMPORT_REFERENCE", "unresolved", u, "project-root-escape", [], None),
        "": ("IMPORT_REFERENCE", "unresolved", u, "invalid-specifier", [], None), "./a?b": ("IMPORT_REFERENCE", "unresolved", u, "query-or-fragment-unsupported", [], None),
        "/abs": ("IMPORT_REFERENCE", "unresolved", u, "absolute-specifier-unsupported", [], None), "a\\b": ("IMPORT_REFERENCE", "unresolved", u, "invalid-specifier", [], None),
        "http://x": ("IMPORT_REFERENCE", "unresolved", u, "url-scheme-unsupported", [], None), "node:": ("IMPORT_REFERENCE", "unresolved", u, "node-builtin-name-missing", [], None),
        "node:fs": ("IMPORTS_EXTERNAL", "exact", "tsjs-external-node-builtin", "none", [0], None), "react": ("IMPORTS_EXTERNAL", "exact", "tsjs-external-bare", "none", [0], None), "..": ("IMPORTS_EXTERNAL", "exact", "tsjs-external-bare", "none", [0], None),
    }
    assert resolve(spark, "src/main.ts", list(cases), paths) == cases


def test_java_imports(spark):
    def java(path, package, symbols=(), **more):
        return file(path, language="java", packageName=package, symbols=list(symbols), **more)

    cases = {
        ("a.b.Top", False, False): ("JAVA_IMPORTS_TYPE", "exact", "java-explicit-top-level-fqn", "none"), ("a.b.Top.max", True, False): ("JAVA_IMPORTS_STATIC_OWNER", "exact", "java-explicit-static-owner-fqn", "none"),
        ("a.b.Top.In", False, False): ("JAVA_IMPORTS_TYPE", "heuristic", "java-immediate-container-heuristic", "none"), ("a.b.Top.In.Deep", False, False): ("JAVA_IMPORTS_TYPE", "unresolved", "unresolved-java-import", "java-deep-nested-unsupported"),
        ("a.b.Dup", False, False): ("JAVA_IMPORTS_TYPE", "unresolved", "unresolved-java-import", "java-duplicate-fqn"), ("q.X", False, False): ("JAVA_IMPORTS_TYPE", "unresolved", "unresolved-java-import", "no-candidate"),
        ("a.b.Nope.f", True, False): ("JAVA_IMPORTS_STATIC_OWNER", "unresolved", "unresolved-java-import", "java-static-owner-missing"), ("a.b", False, True): ("JAVA_IMPORT_NAME", "unresolved", "unresolved-java-import", "java-wildcard-unsupported"),
        ("a.b.Top", None, None): ("JAVA_IMPORT_NAME", "unresolved", "unresolved-java-import", "java-import-flags-missing"), ("a..b", False, False): ("JAVA_IMPORT_NAME", "unresolved", "unresolved-java-import", "invalid-specifier"),
        ("a.b.Broken", False, False): ("JAVA_IMPORTS_TYPE", "unresolved", "unresolved-java-import", "no-candidate"),
    }
    files = [
        java("Top.java", "a.b", [sym("Top", "class", relationships={"extends": ["Base"], "implements": ["I", "J"], "permits": []}), sym("In", "class", "Top"), sym("Deep", "class", "In")]),
        java("D1.java", "a.b", [sym("Dup", "class")]), java("D2.java", "a.b", [sym("Dup", "class")]), java("Bad.java", "a.b", [sym("Broken", "class")], kind="lexical", degradedReason="parse error"),
        java("Main.java", "m", imports=[imp(r, ["x"], s, w) for r, s, w in cases]),
    ]
    g = G.build_graph(table(spark, files))
    refs = {r.id: (r.raw, r.static, r.wildcard) for r in g.references.where("kind = 'java-import-name'").collect()}
    got = {refs[e.referenceId]: (e.relation, e.status, e.rule, e.reason) for e in g.edges.where("relation LIKE 'JAVA_IMPORT%'").collect()}
    assert got == cases
    assert g.edges.where("relation = 'JAVA_IMPLEMENTS_NAME'").count() == 2 and g.edges.where("relation = 'JAVA_EXTENDS_NAME'").count() == 1
    assert G.violations(g).count() == 0


def test_assembly_ids_and_evidence(spark):
    twice = [sym("alpha", exported=True, signature="function alpha(): void")] * 2
    f = file("src/a.ts", symbols=twice, exports=[{"name": "alpha", "source": None, "typeOnly": False}] * 70, dependencies=["x"])
    g = G.build_graph(table(spark, [f]))
    assert g.symbols.count() == 2 and {r.occurrenceOrdinal for r in g.symbols.collect()} == {1, 2}
    # Ids of the first symbol, its export's reference, its edge and evidence.
    ids = {r.occurrenceOrdinal: r.id for r in g.symbols.collect()}
    assert ids[1] == "symbol:sha256:h9nuEtOEYBO8jt3XOkM-0iVwfj6BL6jj6NwmcnyTrMI"
    assert g.references.where("kind = 'export-name'").first().id == "reference:sha256:5f_M5P2oyJ6oc8V7vWiMtBroauBrl2MfjCVpeqHtcUc"
    declares = g.edges.where((F.col("relation") == "DECLARES") & (F.col("targetId") == ids[1])).first()
    assert declares.id == "edge:sha256:2UJQHGJeqVU76K8IaEXD_Y95VD2RaUS_66zM-95WFaM"
    assert declares.evidence == ["evidence:sha256:lX37sbg8HfAVD_14pbz_OK7wiDYf6JeWRMhwOsGsOoc"]
    named = g.edges.where("relation = 'EXPORTS_NAME'").first()
    assert (named.evidenceCount, len(named.evidence), named.omittedEvidenceCount, named.reason) == (70, 64, 6, "export-symbol-binding-unavailable")
    assert g.edges.where("relation = 'DEPENDS_ON_RAW'").first().rule == "unresolved-raw-dependency"
    assert G.violations(g).count() == 0
    again = G.build_graph(table(spark, [f]).repartition(3))
    assert [r.id for r in again.edges.collect()] == [r.id for r in g.edges.collect()]


def test_graph_of_nothing_and_limits(spark):
    g = G.build_graph(table(spark, []))
    assert g.edges.count() == 0 and G.violations(g).count() == 0
    guards.check_input(table(spark, []))
    guards.check_graph(g)


def test_what_a_graph_is_built_from_is_checked(spark):
    name = lambda **more: {"name": "n", "kind": "class", "signature": "s", "exported": True, "line": 1, "container": None, "annotations": None, "modifiers": None, "typeParameters": None, "relationships": None, **more}
    cases = {
        "invalid-path": [file("../x"), file("/abs"), file(None)], "invalid-enum": [file("k", kind="odd"), file("l", language="c"), file("s", symbols=[name(kind="odd")])],
        "invalid-hash": [file("h", contentHash="A" * 64), file("i", contentHash="a" * 63)], "invalid-snapshot": [file("z", sizeBytes=-1), file("./dot")],
        "nested-bound-exceeded": [
            file("p" * 5000), file("t", lexicalTerms=["x"] * 2001), file("n", imports=[imp("a", ["b"] * 1025)]), file("m", symbols=[name(modifiers=["m"] * 1025)]), file("g", symbols=[name(signature="s" * 16_385)]),
            file("q", packageName="p" * 16_385), file("r", symbols=[name(relationships={"extends": ["a"] * 5001, "implements": ["a"] * 5000, "permits": []})]),
        ],
    }
    rows = [f for fs in cases.values() for f in fs]
    got = {(r.path, r.code) for r in guards.failures(table(spark, [file("good", symbols=[name()], imports=[imp("a", ["b"])]), file("twice"), file("twice"), *rows])).collect()}
    assert got == {(f["path"], code) for code, fs in cases.items() for f in fs} | {("twice", "path-collision")}
    for files, limits, code, phase in (
        ([file("b"), file("a"), file("b")], {}, "path-collision", "canonicalize"), ([file("a"), file("b")], {"files": 1}, "count-bound-exceeded", "validate"), ([file("a", symbols=[name(), name()])], {"symbols": 1}, "count-bound-exceeded", "validate"),
        ([file("a")], {"canonicalInputBytes": 9}, "canonical-input-bound-exceeded", "identify"),
    ):
        with pytest.raises(G.GraphError) as e:
            guards.check_input(table(spark, files), schema.GRAPH_LIMITS | limits)
        assert (e.value.code, e.value.phase) == (code, phase)
    g = G.build_graph(table(spark, [file("a", symbols=[name()], imports=[imp("b", ["c"])])]))
    guards.check_graph(g)
    for limits, code in (({"edges": 0}, "count-bound-exceeded"), ({"serializedGraphBytes": 9}, "serialized-graph-bound-exceeded")):
        with pytest.raises(G.GraphError, match=code):
            guards.check_graph(g, schema.GRAPH_LIMITS | limits)


# State


def test_outcome_matrix(spark):
    base = spark.createDataFrame([(p, "old") for p in "abcdefgh"], "path string, hash string")
    rows = [("a", "indexed", "new"), ("b", "indexed", "old"), ("c", "ignored", None), ("d", "missing", None), ("e", "non-text", "bin"), ("f", "non-regular", None), ("g", "read-error", None), ("x", "missing", None), ("y", "indexed", "n"), ("z", "read-error", None)]
    got = {r.path: (r.hash, r.dirty, r.pending) for r in ST.apply_outcomes(base, spark.createDataFrame(rows, "path string, outcome string, hash string")).collect()}
    import hashlib

    assert got == {
        "a": ("new", "new", False), "b": ("old", None, False), "c": (None, None, False), "d": (None, "deleted", False), "e": (None, "bin", False), "f": (None, hashlib.sha256(b"non-regular\0f").hexdigest(), False),
        "g": ("old", None, True), "h": ("old", None, False), "x": (None, None, False), "y": ("n", "n", False), "z": (None, None, True),
    }


def test_reconcile(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    out = ST.reconcile(t([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string"), t([("a", "9", True), ("d", None, True), ("e", None, False), ("f", "5", False)], "path string, hash string, tracked boolean"), t([("c",), ("g",)], "path string"))
    assert {r.path: r.hash for r in out.collect()} == {"a": "9", "c": "3", "d": "deleted", "f": "5"}


def test_freshness_and_revision(spark):
    f = lambda *a: spark.range(1).select(ST.freshness(*a)).first()[0]
    assert [f(1, 0, 0, 0, 0, 0), f(0, 0, 0, 0, 2, 1), f(0, 0, 0, 0, 0, 1), f(0, 0, 0, 0, 0, 0), f(False, 1, 0, 0, 1, 1)] == ["stale", "unsupported", "dirty", "fresh", "stale"]
    import hashlib

    rows = [("b", "2"), ("a", "1"), ("c", None)]
    for order in (rows, rows[::-1]):
        assert ST.revision("head", spark.createDataFrame(order, "path string, hash string")).first()[0] == hashlib.sha256(b"head\0a\0001\0b\0002").hexdigest()
    assert ST.revision("no-head", spark.createDataFrame([], "path string, hash string")).first()[0] == hashlib.sha256(b"no-head").hexdigest()


def test_diagnostics(spark):
    rows = [(f"p{k:03d}", "read-error") for k in range(37)] + [(f"q{k:03d}", "parse-error") for k in range(131)] + [("./p000", "read-error"), ("p000", "read-error")]
    got = ST.bounded(ST.diagnostics(spark.createDataFrame(rows, "path string, code string"))).collect()
    errors, warnings = ([r for r in got if r.severity == s] for s in ("error", "warning"))
    assert (len(errors), len(warnings)) == (32, 128)
    assert sorted(r.omittedCount for r in got if r.omittedCount) == [4, 6]
    assert next(r.occurrenceCount for r in errors if r.path == "p000") == 3
    assert len(ST.bounded(ST.diagnostics(spark.createDataFrame(rows[:32], "path string, code string"))).collect()) == 32


def test_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"), retention=2)
    files = lambda k: table(spark, [file(f"f{i}", contentHash=f"{k:064d}") for i in range(3)])
    assert store.active() is None
    assert [store.activate(files(1)), store.activate(files(1)), store.activate(files(2)), store.activate(files(2), head="h"), store.activate(files(4), head="h")] == [1, 1, 2, 3, 4]
    assert list(store.generations()) == [3, 4] and store.active()["generation"] == 4
    assert {r.contentHash for r in store.load().collect()} == {f"{4:064d}"}
    assert Store(spark, str(tmp_path / "state"), retention=9, quota=1).prune(4) == [3]
    (tmp_path / "state" / "active.json").write_text("{")
    with pytest.raises(ValueError, match="damaged"):
        store.active()


def test_content_identity_ignores_order(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(50)], "path string, n long")
    assert ST.content_identity(df) == ST.content_identity(df.repartition(7)) != ST.content_identity(df.limit(49))


# Merge


def test_live_merge_order(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, rank long, score double")
    got = M.live_merge(t([("p", 1, 9.0)]), t([("a", 1, 5.0), ("p", 2, 4.0), ("b", 3, 3.0), ("gone", 4, 2.0)]), t([("b", 7, 8.0), ("n", 8, 1.0)]), spark.createDataFrame([("gone",)], "path string"), 4)
    assert [(r.path, r.score) for r in got.collect()] == [("p", 9.0), ("a", 5.0), ("b", 8.0), ("n", 1.0)]
    e = lambda rows: spark.createDataFrame(rows, "path string, excerpt string")
    assert {r.path: (r.excerpt, r.evidence) for r in M.with_evidence(got, e([("a", "x")]), e([("a", "y"), ("b", "z")])).collect()} == {"p": (None, None), "a": ("x", "pending"), "b": ("z", "indexed"), "n": (None, None)}


def test_payloads_are_bounded():
    payload = {"query": "q" * 100, "results": [{"path": f"p{i}", "score": 1.0} for i in range(20)], "evidence": [{"path": f"p{i}", "excerpt": "é" * 400} for i in range(20)], "pendingPaths": ["x" * 50] * 30}
    assert json.loads(M.bound_payload(payload, 100_000)) == payload
    for most in (6144, 2000, 700, 512):
        text = M.bound_payload(payload, most)
        got = json.loads(text)
        assert len(text.encode()) <= most and {e["path"] for e in got["evidence"]} <= {r["path"] for r in got["results"]}
        assert "pendingPaths" in got["truncatedFields"]
    with pytest.raises(ValueError):
        M.bound_payload({}, 100)


# Streams


def test_streams_match_batches(spark, tmp_path):
    kind = "path string, event string, seq long"
    log = tmp_path / "log"
    for k in range(5):
        rows = [(f"p{(k * 7 + i) % 11}", ["add", "change", "unlink"][(i + k) % 3], k * 100 + i) for i in range(30)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(log))
    everything = spark.read.schema(kind).parquet(str(log))
    stream = lambda: C.read_changes(spark, str(log), kind, per_trigger=2)
    got = {r.path: (r.seq, r.event, r.applied) for r in C.drain(C.latest(stream()), str(tmp_path / "a"), "update", ["path"], "seq").collect()}
    last = ST.last_events(everything, ["seq"]).collect()
    n = {r.path: r.n for r in everything.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert got == {r.path: (r.seq, r.event, n[r.path]) for r in last}
    counts = {r.event: r.n for r in C.drain(C.counts(stream(), "event"), str(tmp_path / "b"), "update", ["event"], None).collect()}
    assert counts == {r.event: r["count"] for r in everything.groupBy("event").count().collect()}
    # What comes later is taken up from where the last call ended.
    spark.createDataFrame([("p0", "unlink", 10_000)], kind).coalesce(1).write.mode("append").parquet(str(log))
    again = {r.path: (r.seq, r.event, r.applied) for r in C.drain(C.latest(stream()), str(tmp_path / "a"), "update", ["path"], "seq").collect()}
    assert again["p0"] == (10_000, "unlink", n["p0"] + 1) and {k: v for k, v in again.items() if k != "p0"} == {k: v for k, v in got.items() if k != "p0"}


def test_queries_and_their_sql_agree_on_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert I.domain_id_of("x:", "d", {}) != I.domain_id_of("x:", "e", {})
