"""Analyzers of sources, and the file table that they fill."""

import pytest

from cairn.sources import files as FS
from cairn.sources.analyzers import java, script
from cairn.sources.analyzers.lexer import ParseError

SCRIPT = """#!/usr/bin/env node
import def, { one as uno, type Two } from "./mod";
import * as ns from 'ns-mod'
import type { T } from "types";
import "side-effect";
export { a, b as c, type D } from "./re";
export * from "./all";
export * as space from "./space";
export type { E };
// function hidden() {}
export default class Widget extends Base<string> { method() { return /[}]/.test(`${{}}`); } }
export async function load<T extends { x: number }>(url: string, retries = 3, flag = false, name = "x", cb?: (e: Error) => void, ...rest: T[]): Promise<T> {
  function inner() {}
}
function* gen() {}
export interface Shape { area(): number }
export type Id = string | number;
export const enum Color { Red }
declare namespace NS.Inner { const z: number }
export const x: number = 1, y = 2;
let fs = require("fs"), q = require("a" + "b");
exports.named = 1;
module.exports.other = function () {};
module.exports = {};
if (x) { function notTop() {} }
"""


def test_script_declarations():
    got = script.analyze(SCRIPT)
    assert [(i["source"], i["names"], i["typeOnly"]) for i in got["imports"]] == [("./mod", ["def", "uno", "Two"], False), ("ns-mod", ["ns"], False), ("types", ["T"], True), ("side-effect", [], False), ("fs", ["fs"], False)]
    names = [(e["name"], e["source"], e["typeOnly"]) for e in got["exports"]]
    assert names[:6] == [("a", "./re", False), ("c", "./re", False), ("D", "./re", True), ("*", "./all", False), ("*", "./space", False), ("E", None, True)]
    assert names[6:] == [("Widget", None, False), ("default", None, False), ("load", None, False), ("Shape", None, True), ("Id", None, True), ("Color", None, False), ("x", None, False), ("y", None, False), ("named", None, False), ("other", None, False), ("default", None, False)]
    by = {s["name"]: s for s in got["symbols"]}
    assert list(by) == ["Widget", "load", "gen", "Shape", "Id", "Color", "NS.Inner", "x", "y", "fs", "q"]
    assert by["load"]["signature"] == 'function load(url: string, retries?: number, flag?: boolean, name?: string, cb?: (e: Error) => void, ...rest: T[]): Promise<T>'
    assert by["Id"]["signature"] == "type Id = string | number"
    assert (by["Widget"]["kind"], by["Widget"]["line"], by["x"]["signature"], by["q"]["exported"]) == ("class", 11, "const x: number", False)
    assert got["dependencies"] == ["./mod", "ns-mod", "types", "side-effect", "./re", "./all", "./space", "fs"]


def test_script_without_semicolons():
    got = script.analyze("const a = 1\nlet b = a\n  + 2\nfunction f() {\n}\nexport default a\nvar c = [1,\n 2]\nexport const g = (x) => {\n  return x\n}\nclass K {}\n")
    assert [s["name"] for s in got["symbols"]] == ["a", "b", "f", "c", "g", "K"]
    assert [e["name"] for e in got["exports"]] == ["default", "g"]


def test_script_forms():
    got = script.analyze("export default function () {}\nexport = thing;\nexport abstract class A {}\ndeclare function over(a: string): void;\ndeclare module 'm' {}\n@Dec({a: 1}) export class B {}\nexport default 5;\nimport x = require('y');\nimport('dyn');\n")
    assert [(s["name"], s["kind"], s["exported"]) for s in got["symbols"]] == [("default", "function", True), ("A", "class", True), ("over", "function", False), ("'m'", "namespace", False), ("B", "class", True)]
    assert [e["name"] for e in got["exports"]] == ["default", "default", "A", "B", "default"]


@pytest.mark.parametrize("text", ["function (", "const a = 'x\n", "class A {", "import { a } of;", "/* open", "`${a", "foo)"])
def test_script_errors(text):
    with pytest.raises(ParseError):
        script.analyze(text)


JAVA = """package com.acme.app;

import java.util.List;
import static java.lang.Math.*;
import static java.util.Map.Entry;

/** class Fake {} */
@Deprecated
public sealed class Outer<T extends Comparable<T>, U> extends Base<T> implements Runnable, Other<List<T>> permits A, B {
    public static final int X = 1, Y = f(a < b, 2);
    private List<Map<String, int[]>> items = new ArrayList<>();
    @Inject public Outer(final String name) { this.name = name; }
    @Override
    public <R extends Number> R run(List<? super T> in, int... more) throws IOException {
        class Local { void deep() {} }
        Runnable r = new Runnable() { public void run() { } };
        return null;
    }
    abstract void none();
    interface Nested { int K = 3; void go(); default void yes() {} }
    enum Kind implements Marker { ONE(1) { void x() {} }, @Old TWO; Kind() {} int v; }
    static { int y = 0; }
}

record Point(@NotNull int x, List<String> names) implements Shape { Point { } static int zero() { return 0; } }

@interface Note { String value() default "a{b}"; int[] more() default {1, 2}; }
"""


def test_java_declarations():
    got = java.analyze(JAVA)
    assert got["packageName"] == "com.acme.app"
    assert [(i["source"], i["names"], i["static"], i["wildcard"]) for i in got["imports"]] == [("java.util.List", ["List"], False, False), ("java.lang.Math", [], True, True), ("java.util.Map.Entry", ["Entry"], True, False)]
    s = {(x["container"], x["name"], x["kind"]): x for x in got["symbols"]}
    outer = s[(None, "Outer", "class")]
    assert outer["signature"] == "public sealed class Outer<T extends Comparable<T>, U> extends Base<T> implements Runnable, Other<List<T>> permits A, B"
    assert outer["relationships"] == {"extends": ["Base<T>"], "implements": ["Runnable", "Other<List<T>>"], "permits": ["A", "B"]}
    assert (outer["annotations"], outer["modifiers"], outer["typeParameters"], outer["line"]) == (["Deprecated"], ["public", "sealed"], ["T extends Comparable<T>", "U"], 9)
    assert s[("Outer", "X", "field")]["signature"] == "public static final int X"
    assert s[("Outer", "Y", "field")]["signature"] == "public static final int X = 1, Y"
    assert s[("Outer", "items", "field")]["exported"] is False
    assert s[("Outer", "Outer", "constructor")]["signature"] == "public Outer(final String name)"
    run = next(x for x in got["symbols"] if x["name"] == "run" and x["typeParameters"])
    assert run["signature"] == "public <R extends Number> R run(List<? super T> in, int ... more) throws IOException" or run["signature"].startswith("public <R extends Number> R run(")
    assert (run["annotations"], run["line"]) == (["Override"], 14)
    assert {k for k in s if k[0] == "Local"} == {("Local", "deep", "method")}
    assert sum(x["name"] == "run" for x in got["symbols"]) == 2
    assert s[("Nested", "K", "field")]["exported"] and s[("Nested", "go", "method")]["exported"] and not s[("Outer", "Nested", "interface")]["exported"]
    assert [x["name"] for x in got["symbols"] if x["kind"] == "enum-constant"] == ["ONE", "TWO"]
    assert s[("Kind", "TWO", "enum-constant")]["annotations"] == ["Old"]
    assert [(x["name"], x["signature"]) for x in got["symbols"] if x["container"] == "Point" and x["kind"] == "field"] == [("x", "int x"), ("names", "List<String> names")]
    assert ("Point", "Point", "constructor") in s and ("Point", "zero", "method") in s
    assert s[(None, "Note", "annotation")]["kind"] == "annotation" and s[("Note", "value", "method")]["signature"] == 'String value() default "a{b}"'
    assert {"Base<T>", "Base", "Other", "Comparable", "Number", "Shape", "java.util.List"} <= set(got["dependencies"])
    assert [e["name"] for e in got["exports"]] == ["Outer"]


def test_java_without_package_and_with_unicode():
    got = java.analyze("class Größe {\r\n  int breite;\r\n}\r\n")
    assert got["packageName"] is None
    assert [(x["name"], x["line"]) for x in got["symbols"]] == [("Größe", 1), ("breite", 2)]


@pytest.mark.parametrize("text", ["class A {", "class {}", "int x;", "class A { void f( }", "package a", "class A { int }", "{" * 600 + "}" * 600])
def test_java_errors(text):
    with pytest.raises(ParseError):
        java.analyze(text)


def test_file_table(spark):
    rows = [("a/M.java", JAVA.encode()), ("b.ts", SCRIPT.encode()), ("bad.ts", b"class {"), ("x.bin", b"a\0b"), ("notes.txt", "Ünï code".encode()), ("gone.js", None), ("empty.js", b"")]
    got = {r.path: r for r in FS.index_files(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert {p: r.outcome for p, r in got.items()} == {"a/M.java": "indexed", "b.ts": "indexed", "bad.ts": "indexed", "x.bin": "non-text", "notes.txt": "indexed", "gone.js": "read-error", "empty.js": "indexed"}
    assert (got["a/M.java"].file.kind, got["a/M.java"].file.language, got["a/M.java"].file.packageName) == ("semantic", "java", "com.acme.app")
    assert (got["bad.ts"].file.kind, got["bad.ts"].warning.code) == ("lexical", "parse-error") and got["bad.ts"].file.degradedReason.startswith("parse error:")
    assert (got["notes.txt"].file.language, got["notes.txt"].file.sizeBytes) == ("text", 10) and got["x.bin"].file is None


def test_trees_from_disk(spark, tmp_path):
    for name, body in {"src/a.ts": "export const a = 1;", "src/skip.log": "x", ".gitignore": "*.log\n", "node_modules/m/i.js": "x", "docs/d e.md": "hi", "build/x.js": "y"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    files = FS.build(spark, str(tmp_path), excludes=["docs/x*"], use_git=False)
    assert sorted(r.path for r in FS.file_table(files).collect()) == [".gitignore", "docs/d e.md", "src/a.ts"]
    before = files.select("path", "hash")
    (tmp_path / "src/a.ts").write_text("export const a = 2;")
    now = FS.admitted(FS.tree(spark, str(tmp_path)), ignore=["*.log"])
    known = spark.createDataFrame([tuple(r) for r in before.where("path <> 'src/a.ts'").collect()], "path string, hash string")
    assert [r.path for r in FS.changed(now, known).collect()] == ["src/a.ts"]


def test_status_records():
    assert FS.parse_status(" M a.ts\0R  new.ts\0old.ts\0?? u\0") == [("a.ts", True), ("new.ts", True), ("old.ts", True), ("u", False)]
