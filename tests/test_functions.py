"""Column functions and their driver twins."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import paths as P
from cairn.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_lexical_terms(spark):
    assert one(spark, T.lexical_terms("p", "t"), p="src/Ab.ts", t="x Foo foo a-b $y ünï") == ["src", "ab", "ts", "foo", "a-b", "$y", "ünï"]
    assert one(spark, T.lexical_terms("p", "t", 2), p="aa", t="bb cc") == ["aa", "bb"]
    many = " ".join(f"t{i}" for i in range(2500))
    assert len(one(spark, T.lexical_terms("p", "t"), p="p0", t=many)) == 2000


@pytest.mark.parametrize("text", ["", "Foo.bar_baz-Qux", "a..b", "$x _y", "foo.bar foo-bar foo_bar", "é.ñ_1", "..."])
def test_tokens_agree_with_the_driver(spark, text):
    assert one(spark, T.linked_tokens("t"), t=text) == T.query_tokens(text)
    assert one(spark, T.structured_identifiers("t"), t=text) == T.query_structured(text)


def test_linked_tokens():
    assert T.query_tokens("Foo.bar_baz-Qux") == ["Foo.bar_baz-Qux", "Foo", "bar_baz-Qux", "bar", "baz", "Qux"]


def test_aliases(spark):
    got = one(spark, T.path_aliases("p", "k", F.array(F.lit("S"))), p="a/b/C.java", k="x.y")
    assert got == ["a/b/C.java", "a/b/C", "C.java", "C", "a.b.C", "b.C", "x.y", "x.y.S"]
    assert one(spark, T.qualified_aliases("p"), p="a/b/C.java") == ["a.b.c", "b.c"]
    assert one(spark, T.path_aliases("p"), p=".env") == [".env"]


def test_noise(spark):
    for path, want in {"vendor/a.js": (True, False, False), "a/x.min.js": (False, True, False), "locale/de.po": (False, False, True), "po/x.po": (False, False, False), "a.min./b": (False, False, False)}.items():
        assert (one(spark, T.is_vendor("p"), p=path), one(spark, T.is_minified("p"), p=path), one(spark, T.is_locale_catalog("p"), p=path)) == want


def test_anchors():
    assert T.strong_anchors("parseHTTPHeader parse_http x-y plain well-known RFC-2616 v1.2.3 HTTPHeader") == ["parsehttpheader", "rfc-2616", "v1.2.3"]
    assert T.query_terms(" Foo.bar ") == ["foo.bar", "bar", "foo"]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("*.log", ["a.log", "x/a.log"], ["a.logs"]), ("/top", ["top"], ["x/top"]), ("docs/", ["docs/a", "docs/b/c"], ["x/docs/a"]), ("a/**/b", ["a/x/b", "a/x/y/b"], ["a/b"]), ("f?o", ["foo", "x/fao"], ["f/o"]), ("(x)", ["(x)"], ["x"])],
)
def test_globs(spark, pattern, yes, no):
    for path in yes + no:
        assert one(spark, P.excluded_by("p", [pattern]), p=path) is (path in yes), path


def test_excluded_segments(spark):
    for path in ("node_modules/a", "x/.git/y", "build"):
        assert one(spark, P.excluded_by("p", []), p=path)
    assert not one(spark, P.excluded_by("p", []), p="rebuild/Build")


def test_ignore_rules(spark):
    rules = P.ignore_rules(["# no", "", "*.txt", "!keep.txt", "/out/", "!out/kept.md", "logs/**/x", "a/b", "dir/"])
    for path, want in {"a.txt": True, "keep.txt": False, "d/keep.txt": False, "out/kept.md": True, "x/out/y": False, "logs/x": True, "logs/1/2/x": True, "a/b": True, "c/a/b": False, "dir": False, "q/dir/z": True}.items():
        assert one(spark, P.ignored_by("p", rules), p=path) is want, path


def test_canonical_paths(spark):
    for path, want in {"./src//a.ts": "src/a.ts", "/a": None, "C:/a": None, "a\\b": None, "a/../b": None, "": None, "./": None, "a\x01": None, "x" * 5000: None, "é/ü": "é/ü"}.items():
        assert one(spark, P.canonical_path("p"), p=path) == want, path
    assert one(spark, P.scanner_path("p"), p="././a\\b") == "a/b"
    assert one(spark, P.scanner_path("p"), p="a//b") is None


def test_resolve_relative(spark):
    for spec, want in {"./b": "a/b", "../b": "b", "../../b": None, ".": "a", "./x/../y/": "a/y", "../a/./b.ts": "a/b.ts"}.items():
        assert one(spark, P.resolve_relative("i", "s"), i="a/f.ts", s=spec) == want, spec


def test_text_probe(spark):
    assert one(spark, P.is_text("c"), c=bytearray(b"abc"))
    assert not one(spark, P.is_text("c"), c=bytearray(b"a\0c"))
    assert one(spark, P.is_text("c"), c=bytearray(b"\x10\x01" * 10))
    assert one(spark, P.is_text("c"), c=bytearray(b"x" * 8192 + b"\0"))


def test_ids(spark):
    # Fixed value: the id of one path.
    golden = "file:sha256:g9zK0T3zcXFUeLNzYnT06jBUQBOmWBTY_4WLvpvMIjU"
    assert I.domain_id_of("file:sha256:", "repository-graph/file", {"canonicalPath": "src/a.ts"}) == golden
    payload = F.struct(F.col("p").alias("canonicalPath"))
    for path in ("src/a.ts", 'q"\\/é\u2028𝒳', "tab\tnl\nbell\x07\x1f\x0b", "\\u001F \x1f\x1e\\\x1f"):
        got = one(spark, I.domain_id("file:sha256:", "repository-graph/file", payload), p=path)
        assert got == I.domain_id_of("file:sha256:", "repository-graph/file", {"canonicalPath": path})


def test_digests_leave_out_what_is_absent(spark):
    row = F.struct(F.lit("a").alias("name"), F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("types"))
    text = spark.range(1).select(I.canonical_json(row, keep_nulls=False)).first()[0]
    assert json.loads(text) == {"name": "a", "types": []}


@pytest.mark.parametrize(("text", "valid"), [("2024-02-29", True), ("2023-02-29", False), ("2024-01-01T10:20:30.5Z", True), ("2024-01-01T25:00:00Z", False), ("2024-05", True), ("yesterday", False), ("", False), (None, False)])
def test_instants(spark, text, valid):
    assert spark.createDataFrame([(text,)], "t string").select(T.valid_instant("t")).first()[0] is valid
