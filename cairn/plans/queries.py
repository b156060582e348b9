"""The registered queries over the engine's own operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import paths as P
from cairn.functions import text as T
from cairn.operators import graph as G
from cairn.operators import merge as M
from cairn.operators import scan as L
from cairn.operators import search as S
from cairn.operators import state as ST
from cairn.plans.tables import changes, document_path, files, table, texts
from cairn.streaming import changes as C

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Shared SQL: documents as files, and the linked tokens of a text.
DOC_PATH = "source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR) || '.txt'"
IDENT = r"[$_\p{L}\p{N}]+(?:[.-][$_\p{L}\p{N}]+)*"


def sql_tokens(text: str) -> str:
    parts = "list_concat([p], regexp_split_to_array(p, '[_-]+'))"
    return f"list_filter(list_distinct(flatten(list_transform(regexp_extract_all({text}, '{IDENT}'), lambda i: list_concat([i], flatten(list_transform(string_split(i, '.'), lambda p: {parts})))))), lambda t: t <> '')"


SQL_TERMS = rf"list_distinct(regexp_extract_all(lower({DOC_PATH} || ' ' || coalesce(text, '')), '[\p{{L}}\p{{N}}_$-]{{2,}}'))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Text and path functions.


@query(f"SELECT {DOC_PATH} AS path, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT *, {SQL_TERMS} AS t FROM documents)")
def lexical_terms(spark, sf_dir) -> DataFrame:
    """All distinct terms of each file (no cap here: the cap keeps the first 2000 in order of appearance)."""
    t = T.lexical_terms("path", "text", 1 << 30)
    return texts(spark, sf_dir).withColumn("t", t).select("path", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("terms"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(list_sort(t), ' ')) AS tokens FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def linked_tokens(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.linked_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("tokens"))


@query(
    rf"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(flatten(list_transform(regexp_extract_all(url, '{IDENT}'), lambda i: list_concat([i], list_filter(string_split(i, '.'), lambda p: regexp_matches(p, '[_-]'))))), lambda p: regexp_matches(p, '[._-]')), lambda p: lower(p)))), ' ') AS identifiers FROM pages"
)
def structured_identifiers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(T.structured_identifiers("url")), " ").alias("identifiers"))


@query(
    f"SELECT {DOC_PATH} AS path, sha256(coalesce(text, '')) AS content_hash, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes, true AS is_text, false AS is_semantic FROM documents "
    "UNION ALL SELECT 'page-' || page_id || '.js', sha256(coalesce(html, '')), CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT), true, true FROM pages"
)
def file_base_rows(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.col("html").alias("text"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = texts(spark, sf_dir).unionByName(pages).withColumn("content", content)
    return rows.select("path", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), P.is_text("content").alias("is_text"), P.is_semantic("path").alias("is_semantic"))


@query(f"""
WITH p AS (SELECT {DOC_PATH} AS path, source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR) AS bare FROM documents), s AS (SELECT *, string_split(bare, '/') AS g FROM p)
SELECT path, array_to_string(list_sort(list_distinct([path, bare, g[3] || '.txt', g[3], array_to_string(g, '.'), array_to_string(g[2:], '.')])), ' ') AS aliases,
       array_to_string(list_sort([lower(array_to_string(g, '.')), lower(array_to_string(g[2:], '.'))]), ' ') AS qualified FROM s
""")
def path_aliases(spark, sf_dir) -> DataFrame:
    p = texts(spark, sf_dir).select("path")
    return p.select("path", F.array_join(F.array_sort(T.path_aliases("path")), " ").alias("aliases"), F.array_join(F.array_sort(T.qualified_aliases("path")), " ").alias("qualified"))


EXCLUDE = ["src1*/**", "/src2/de/", "*-7?.txt", "!src3/**", "  "]


@query(f"SELECT path, regexp_matches(path, '^src1[^/]*/.*$') OR regexp_matches(path, '^src2/de/.*') OR regexp_matches(path, '(^|.*/)[^/]*-7[^/]\\.txt$') AS excluded FROM (SELECT {DOC_PATH} AS path FROM documents)")
def exclude_globs(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir).select("path", P.excluded_by("path", EXCLUDE).alias("excluded"))


IGNORE = ["# generated", "", "*.txt", "!doc-1*.txt", "/src3/", "!/src3/", "src4/de", "**/fr/", "!doc-2?.txt"]


@query(f"""
WITH p AS (SELECT {DOC_PATH} AS path, source, lang, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS name FROM documents)
SELECT path, (lang = 'fr') OR (source = 'src4' AND lang = 'de') OR NOT (name LIKE 'doc-1%' OR regexp_matches(name, '^doc-2[^/]\\.txt$')) AS ignored FROM p
""")
def ignore_rules(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir).select("path", P.ignored_by("path", P.ignore_rules(IGNORE)).alias("ignored"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS raw FROM pages)
SELECT page_id, CASE WHEN octet_length(encode(raw)) <= 4096 AND NOT regexp_matches(raw, '[\\x00-\\x1f\\x7f\\\\]|^/|^[A-Za-z]:') AND NOT list_contains(string_split(raw, '/'), '..')
  THEN nullif(array_to_string(list_filter(string_split(raw, '/'), lambda s: s NOT IN ('', '.')), '/'), '') END AS canonical FROM p
""")
def canonical_paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.canonical_path(F.regexp_replace("url", "^[a-z]+://", "")).alias("canonical"))


@query("""
WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS raw FROM pages),
c AS (SELECT raw, array_to_string(list_filter(string_split(raw, '/'), lambda s: s NOT IN ('', '.')), '/') AS canonical FROM p)
SELECT canonical, count(DISTINCT raw) AS spellings FROM c WHERE canonical <> '' GROUP BY canonical HAVING count(DISTINCT raw) > 1
""")
def path_collisions(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    return P.path_collisions(raw)


@query("""
WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a/Vendor/' WHEN 1 THEN 'locale/' ELSE 'lib/' END || source || CASE doc_id % 3 WHEN 0 THEN '.min.js' WHEN 1 THEN '.po' ELSE '.txt' END AS path FROM documents)
SELECT doc_id, path, doc_id % 5 = 0 AS vendor, doc_id % 3 = 0 AS minified, doc_id % 5 = 1 AND doc_id % 3 = 1 AS locale_catalog FROM p
""")
def noise_flags(spark, sf_dir) -> DataFrame:
    place = F.when(F.col("doc_id") % 5 == 0, "a/Vendor/").when(F.col("doc_id") % 5 == 1, "locale/").otherwise("lib/")
    end = F.when(F.col("doc_id") % 3 == 0, ".min.js").when(F.col("doc_id") % 3 == 1, ".po").otherwise(".txt")
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat(place, "source", end).alias("path"))
    return p.select("doc_id", "path", T.is_vendor("path").alias("vendor"), T.is_minified("path").alias("minified"), T.is_locale_catalog("path").alias("locale_catalog"))


# Search.

_FIELDS = f"""
f AS (SELECT {DOC_PATH} AS path, 'doc-' || CAST(doc_id AS VARCHAR) AS stem, source, lang, array_to_string({SQL_TERMS}, ' ') AS terms FROM documents),
x AS (
  SELECT path, 'path' AS field, 2.5::DOUBLE AS boost, path AS body FROM f UNION ALL SELECT path, 'fileName', 3.0, stem || '.txt' FROM f UNION ALL SELECT path, 'terms', 1.0, terms FROM f
  UNION ALL SELECT path, 'pathAliases', 4.0, path || ' ' || source || '/' || lang || '/' || stem || ' ' || stem || '.txt ' || stem || ' ' || source || '.' || lang || '.' || stem || ' ' || lang || '.' || stem FROM f),
k AS (SELECT path, field, boost, {sql_tokens("body")} AS t FROM x),
post AS (SELECT path, field, boost, len(t) AS n, lower(unnest(t)) AS term FROM k),
p AS (SELECT path, field, boost, n, term, count(*) AS tf FROM post GROUP BY ALL),
a AS (SELECT field, avg(len(t)) AS avg_n FROM k GROUP BY field),
d AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
v AS (SELECT DISTINCT term FROM p)"""


def _sql_bm25(terms: list[str], prefix: bool, fuzzy: bool) -> str:
    """CTEs up to ``hits`` (path, score, query_terms)."""
    cases = []
    for q in terms:
        size, d = "length(term)::DOUBLE", S.max_distance(q)
        w = f"CASE WHEN term = '{q}' THEN 1.0::DOUBLE"
        w += f" WHEN starts_with(term, '{q}') THEN 0.375::DOUBLE * {size} / ({size} + 0.3::DOUBLE * ({size} - {len(q)}))" if prefix else ""
        w += f" WHEN abs(length(term) - {len(q)}) <= {d} AND levenshtein(term, '{q}') <= {d} THEN 0.45::DOUBLE * {size} / ({size} + levenshtein(term, '{q}'))" if fuzzy and d else ""
        cases.append(f"SELECT term, '{q}' AS q, {w} END AS w FROM v")
    return f"""{_FIELDS},
e AS (SELECT * FROM ({" UNION ALL ".join(cases)}) WHERE w IS NOT NULL),
hits AS (
  SELECT path, sum(w * boost * ln(1.0::DOUBLE + ((SELECT count(*) FROM f) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * n / avg_n))))
         * count(DISTINCT q) AS score, list_sort(list(DISTINCT q)) AS query_terms
  FROM p JOIN e USING (term) JOIN d USING (field, term) JOIN a USING (field) GROUP BY path)"""


_INDEXES: dict[tuple, S.Index] = {}


def _index(spark, sf_dir) -> S.Index:
    """The stored index of the documents, built anew when the session or the table's files have changed."""
    parts = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(map(str, parts))))
    if key not in _INDEXES:
        _INDEXES.clear()
        # Documents are longer than the cap on terms; here all terms are kept, so that the SQL needs no order.
        _INDEXES[key] = S.build_index(files(spark, sf_dir, 1 << 30))
    return _INDEXES[key]


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("path", F.round("score", 6).alias("score"), F.array_join("query_terms", " ").alias("query_terms"))


_ROUND = "SELECT path, round(score, 6) AS score, array_to_string(query_terms, ' ') AS query_terms FROM hits"


@query(f"WITH {_FIELDS} SELECT field, count(DISTINCT path) AS files, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(n) AS BIGINT) AS lens FROM p GROUP BY field")
def postings(spark, sf_dir) -> DataFrame:
    p = _index(spark, sf_dir).postings
    return p.groupBy("field").agg(F.count_distinct("path").alias("files"), F.count("*").alias("postings"), F.sum("tf").alias("tf"), F.sum("len").alias("lens"))


@query(f"WITH {_FIELDS} SELECT field, round(avg_n, 6) AS avg_len FROM a")
def field_stats(spark, sf_dir) -> DataFrame:
    index = _index(spark, sf_dir)
    empty = {"symbols", "signatures", "exports", "imports"}
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in index.averages.items() if k not in empty], "field string, avg_len double")


@query(f"WITH {_sql_bm25(['thtion', 'erth'], False, False)} {_ROUND}")
def bm25_exact(spark, sf_dir) -> DataFrame:
    return _rounded(S.bm25(_index(spark, sf_dir), "thtion erth", prefix=False, fuzzy=False))


@query(f"WITH {_sql_bm25(['thtion', 'erth'], True, False)} {_ROUND}")
def bm25_prefix(spark, sf_dir) -> DataFrame:
    return _rounded(S.bm25(_index(spark, sf_dir), "thtion erth", fuzzy=False))


@query(f"WITH {_sql_bm25(['thtion', 'erthand'], False, True)} {_ROUND}")
def bm25_fuzzy(spark, sf_dir) -> DataFrame:
    return _rounded(S.bm25(_index(spark, sf_dir), "thtion erthand", prefix=False))


@query(f"""WITH {_sql_bm25(["src3", "thtion", "doc-12", "doc", "12"], True, True)},
top AS (SELECT * FROM hits ORDER BY score DESC, path LIMIT least((SELECT count(*) FROM f), 400)),
r AS (
  SELECT path, query_terms, ln(1 + score) + 3.0 * len(list_intersect(['src3', 'thtion', 'doc-12', 'doc', '12'], query_terms)) / 5.0 + CASE WHEN list_contains(terms_, 'doc-12') THEN 8.0 ELSE 0.0 END AS s, terms_
  FROM top JOIN (SELECT path, string_split(terms, ' ') AS terms_ FROM f) USING (path))
SELECT path, round(s, 6) AS score, CASE WHEN list_contains(terms_, 'doc-12') THEN 'exact identifier: doc-12;' ELSE '' END || 'matched terms: ' || array_to_string(query_terms[1:2], ', ') AS reasons
FROM r ORDER BY s DESC, path LIMIT 20""")
def search_rerank(spark, sf_dir) -> DataFrame:
    found = S.search(_index(spark, sf_dir), "src3 thtion doc-12", limit=20)
    return found.select("path", F.round("score", 6).alias("score"), F.array_join("matchReasons", ";").alias("reasons"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda s: contains(lower(s), 'part') OR contains(lower(s), '12')), ' ') AS matched FROM part")
def matched_symbols(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.holding(F.split("p_name", " "), ["part", "12"]), " ").alias("matched"))


# Lexical scan.

SCAN_QUERY = "then the_order src1"
_SCAN_TERMS = T.query_terms(SCAN_QUERY)
_has = lambda col: " + ".join(f"CAST(contains({col}, '{t}') AS INTEGER)" for t in _SCAN_TERMS)
_any = " + ".join(f"CAST(contains(lp, '{t}') OR contains(lt, '{t}') AS INTEGER)" for t in _SCAN_TERMS)
_SCORED = f"s AS (SELECT path, {_any} AS coverage, {_has('lp')} AS in_path, contains(lt, '{SCAN_QUERY}') AS et, contains(lp, '{SCAN_QUERY}') AS ep FROM (SELECT {DOC_PATH} AS path, lower({DOC_PATH}) AS lp, lower(coalesce(text, '')) AS lt FROM documents))"


@query(f"WITH {_SCORED} SELECT path, CAST(coverage AS INTEGER) AS coverage, CAST(coverage * 100 + in_path * 25 + CASE WHEN et THEN 60 ELSE 0 END + CASE WHEN ep THEN 80 ELSE 0 END AS INTEGER) AS score FROM s WHERE coverage > 0")
def scan_score(spark, sf_dir) -> DataFrame:
    return L.scored(texts(spark, sf_dir), SCAN_QUERY).select("path", "coverage", "score")


@query(f"""
WITH f AS (SELECT {DOC_PATH} AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents),
r AS (SELECT *, row_number() OVER w AS rank, sum(least(size, 524288)) OVER w - least(size, 524288) AS before FROM f WINDOW w AS (ORDER BY encode(path) ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, (rank - 1) // 4 AS batch FROM r WHERE rank <= 20000),
c AS (SELECT *, min(before) OVER (PARTITION BY batch) AS spent, count(*) OVER (PARTITION BY batch) AS members FROM b),
a AS (SELECT *, least(524288, floor((greatest(33554432 - spent, 0) + (rank - 1) % 4) / members)) AS allowed FROM c)
SELECT path, CAST(batch AS BIGINT) AS batch, CAST(least(size, allowed) AS BIGINT) AS bytes, size > allowed AS truncated FROM a WHERE allowed > 0
""")
def scan_budget(spark, sf_dir) -> DataFrame:
    sizes = texts(spark, sf_dir).select("path", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return L.budget(sizes).select("path", "batch", F.col("bytes").cast("long").alias("bytes"), "truncated")


_NAMES = ("mail5.example.com", "mail3.example.com", "mail2.example.com", "enbest.54", "hein.19", "that.92")


@query(f"""
WITH f AS (SELECT {DOC_PATH} AS path, row_number() OVER (ORDER BY encode({DOC_PATH})) AS rank, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.-]+') AS runs FROM documents),
h AS (SELECT min((rank - 1) // 4) AS stop FROM f WHERE len(list_intersect(runs, {list(_NAMES)})) >= 2)
SELECT path, CAST((rank - 1) // 4 AS BIGINT) AS batch FROM f, h WHERE (rank - 1) // 4 <= stop
""")
def scan_early_stop(spark, sf_dir) -> DataFrame:
    """The batches that a scan reads up to the first one with a telling text."""
    marked = L.strong_batches(texts(spark, sf_dir), " ".join(_NAMES)).select("path", "strong")
    ranked = L.running(marked, ["path"], {"rank": "1L"}).withColumn("batch", F.floor((F.col("rank") - 1) / L.BATCH))
    stop = ranked.where("strong").agg(F.min("batch").alias("stop"))
    return ranked.join(F.broadcast(stop), F.col("batch") <= F.col("stop")).select("path", "batch")


@query(f"""
WITH f AS (SELECT {DOC_PATH} AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents)
SELECT count(*) AS paths, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN max(size) > 8192 THEN 'file-prefix-cap' ELSE 'matched' END AS reason, CASE WHEN max(size) > 8192 THEN 'source' ELSE 'complete' END AS stage FROM f
""")
def scan_terminal(spark, sf_dir) -> DataFrame:
    sizes = texts(spark, sf_dir).select("path", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    row = sizes.agg(F.count("*").alias("n"), F.sum(F.octet_length("path") + 1).alias("b"), F.sum("size").alias("s"), F.max("size").alias("m")).first()
    big = 1 << 50
    reason, stage = L.terminal({"n": row["n"], "b": row["b"]}, row["n"], 0, row["m"] > 8192, False, 1, L.Limits(paths=big, path_bytes=big, files=big))
    return spark.createDataFrame([(row["n"], row["s"], reason, stage)], "paths long, bytes long, reason string, stage string")


@query(f"""
WITH f AS (SELECT {DOC_PATH} AS path, doc_id, octet_length(encode(coalesce(text, ''))) > 4096 AS cut FROM documents)
SELECT path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) AND NOT cut THEN 'conclusive' ELSE 'unresolved' END AS status FROM f
""")
def scan_classify(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", document_path())
    read = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path", (F.octet_length(F.coalesce("text", F.lit(""))) > 4096).alias("truncated"))
    return L.classify(docs, read)


@query("""
WITH m AS (SELECT doc_id, text, instr(lower(text), 'license') AS pos FROM documents WHERE contains(lower(text), 'license')),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, len(string_split(substr(text, 1, pos), chr(10))) AS n FROM m)
SELECT doc_id, trim(array_to_string(ls[greatest(n - 1, 1) : n + 1], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS excerpt FROM l
""")
def excerpts(spark, sf_dir) -> DataFrame:
    hits = table(spark, sf_dir, "documents").where(F.lower("text").contains("license")).select("doc_id", document_path().alias("path"), "text")
    return L.with_excerpts(hits, "license", L.Limits(excerpt_bytes=1 << 20)).select("doc_id", "excerpt")


# Graph.

_B64 = lambda prefix, js: f"'{prefix}' || rtrim(translate(to_base64(unhex(sha256({js}))), '+/', '-_'), '=')"


@query(f"""
WITH n AS (SELECT r_name || '/' || n_name || '.ts' AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
i AS (SELECT path, {_B64("file:sha256:", "'{\"domain\":\"repository-graph/file\",\"payload\":{\"canonicalPath\":\"' || path || '\"},\"version\":1}'")} AS file_id FROM n)
SELECT path, file_id, {_B64("reference:sha256:", "'{\"domain\":\"repository-graph/reference\",\"payload\":{\"kind\":\"module-specifier\",\"language\":\"typescript\",\"raw\":\"' || path || '\"},\"version\":1}'")} AS reference_id FROM i
""")
def graph_ids(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = n.select(F.concat("r_name", F.lit("/"), "n_name", F.lit(".ts")).alias("path"))
    return p.select("path", G.file_id(F.col("path")).alias("file_id"), G.reference_id(kind=F.lit("module-specifier"), language=F.lit("typescript"), raw=F.col("path")).alias("reference_id"))


@query("""
SELECT l_suppkey, l_partkey % 10 AS target, count(*) AS evidence_count, count(*) - least(count(*), 64) AS omitted,
       md5(array_to_string((list_sort(list(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR))))[1:64], ',')) AS evidence
FROM lineitem GROUP BY l_suppkey, l_partkey % 10
""")
def edge_collapse(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 10).alias("target"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("evidenceId"))
    out = G.collapse(e, ["l_suppkey", "target"])
    return out.select("l_suppkey", "target", F.col("evidenceCount").alias("evidence_count"), F.col("omittedEvidenceCount").alias("omitted"), F.md5(F.array_join("evidence", ",").cast("binary")).alias("evidence"))


_SPEC = "CASE doc_id % 6 WHEN 0 THEN './m' || CAST(doc_id + 6 AS VARCHAR) WHEN 1 THEN '../de/m' || CAST(doc_id AS VARCHAR) || '.js' WHEN 2 THEN '../../../x' WHEN 3 THEN './' WHEN 4 THEN './m' || CAST(doc_id AS VARCHAR) || '.ts' ELSE '../m' || CAST(doc_id AS VARCHAR) END"
_TS_PATH = "source || '/' || lang || '/m' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.js' END"


def _module_files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.select("doc_id", F.expr(_TS_PATH.replace("AS VARCHAR", "AS STRING")).alias("path"), F.expr(_SPEC.replace("AS VARCHAR", "AS STRING")).alias("raw"))


@query(f"""
WITH f AS (SELECT doc_id, {_TS_PATH} AS path, source, lang, {_SPEC} AS raw FROM documents),
b AS (
  SELECT doc_id, raw, CASE doc_id % 6 WHEN 0 THEN source || '/' || lang || '/m' || (doc_id + 6) WHEN 1 THEN source || '/de/m' || doc_id || '.js' WHEN 3 THEN source || '/' || lang
    WHEN 4 THEN source || '/' || lang || '/m' || doc_id || '.ts' WHEN 5 THEN source || '/m' || doc_id END AS base FROM f),
sfx AS (SELECT * FROM (VALUES ('.ts', 0), ('.tsx', 1), ('.mts', 2), ('.cts', 3), ('.js', 4), ('.jsx', 5), ('.mjs', 6), ('.cjs', 7)) t(s, i)),
sub AS (SELECT * FROM (VALUES ('.ts', 0), ('.tsx', 1), ('.d.ts', 2)) t(s, i)),
pr AS (
  SELECT doc_id, base AS probe, 0 AS precedence FROM b WHERE raw NOT LIKE '%/' AND base IS NOT NULL
  UNION ALL SELECT doc_id, regexp_replace(base, '\\.js$', '') || s, 100 + i FROM b, sub WHERE base LIKE '%.js' AND base NOT IN (SELECT path FROM f)
  UNION ALL SELECT doc_id, base || s, 200 + i FROM b, sfx WHERE doc_id % 6 IN (0, 5)
  UNION ALL SELECT doc_id, base || '/index' || s, 300 + i FROM b, sfx WHERE doc_id % 6 IN (0, 3, 5)),
c AS (SELECT pr.doc_id, precedence, path FROM pr JOIN (SELECT path FROM f) ON probe = path),
m AS (SELECT doc_id, min(precedence) AS precedence, count(*) AS candidates FROM c GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN f.doc_id % 6 = 2 THEN 'project-root-escape' WHEN m.doc_id IS NULL THEN 'no-candidate' ELSE 'none' END AS reason,
       CASE WHEN m.doc_id IS NULL THEN 'unresolved' WHEN m.precedence = 0 THEN 'exact' ELSE 'heuristic' END AS status, c.path AS target, coalesce(candidates, 0) AS candidates
FROM f LEFT JOIN m USING (doc_id) LEFT JOIN c ON c.doc_id = m.doc_id AND c.precedence = m.precedence
""")
def resolve_relative(spark, sf_dir) -> DataFrame:
    modules = _module_files(spark, sf_dir)
    ids = modules.select(G.file_id(F.col("path")).alias("id"), "path")
    work = modules.select(F.col("doc_id").cast("string").alias("sourceFileId"), F.col("raw").alias("referenceId"), F.lit("tsjs-import").alias("workKind"), "path", "raw", F.lit("typescript").alias("language"))
    out = G.resolve_modules(work, ids).join(ids.select(F.col("id").alias("targetId"), F.col("path").alias("target")), "targetId", "left")
    return out.select(F.col("sourceFileId").cast("long").alias("doc_id"), "reason", "status", "target", F.size("candidates").cast("long").alias("candidates"))


@query("""
WITH j AS (SELECT 'r' || n_regionkey || '.p' || (n_nationkey % 3) AS package, n_name AS outer_name, n_nationkey FROM nation),
t AS (SELECT package || '.' || outer_name AS fqn, n_nationkey AS id FROM j), i AS (SELECT package, outer_name || '.S' || s_suppkey AS spelling, n_nationkey AS id FROM j JOIN supplier ON s_nationkey = n_nationkey),
w AS (
  SELECT s_suppkey AS k, package || '.' || outer_name || '.S' || s_suppkey AS raw, false AS st FROM j JOIN supplier ON s_nationkey = n_nationkey
  UNION ALL SELECT 1000000 + n_nationkey, package || '.' || outer_name, false FROM j UNION ALL SELECT 2000000 + n_nationkey, package || '.' || outer_name || '.MAX', true FROM j
  UNION ALL SELECT 3000000 + n_nationkey, package || '.A.B.C', false FROM j UNION ALL SELECT 4000000 + n_nationkey, 'q.' || outer_name, false FROM j)
SELECT k, CASE WHEN k < 1000000 THEN 'heuristic' WHEN k < 3000000 THEN 'exact' ELSE 'unresolved' END AS status,
       CASE WHEN k < 3000000 THEN 'none' WHEN k < 4000000 THEN 'java-deep-nested-unsupported' ELSE 'no-candidate' END AS reason,
       CASE WHEN k < 1000000 THEN (SELECT 'f' || id FROM i WHERE package || '.' || spelling = raw) WHEN k < 2000000 THEN (SELECT 'f' || id FROM t WHERE fqn = raw)
            WHEN k < 3000000 THEN (SELECT 'f' || id FROM t WHERE fqn || '.MAX' = raw) END AS target FROM w
""")
def resolve_fqn(spark, sf_dir) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    package = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".p"), (F.col("n_nationkey") % 3).cast("string"))
    j = nation.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("id"), package.alias("packageName"), "n_name", "n_nationkey")
    nodes = j.select("id", F.lit("java").alias("language"), F.lit("semantic").alias("kind"), F.lit(None).cast("string").alias("degradedReason"), "packageName")
    s = j.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("inner", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    symbol = lambda df, name, container: df.select(F.col("id").alias("fileId"), F.lit("class").alias("symbolKind"), F.col(name).alias("name"), (F.col(container) if container else F.lit(None).cast("string")).alias("container"))
    symbols = symbol(j, "n_name", None).unionByName(symbol(s, "inner", "n_name"))
    dot = lambda *c: F.concat_ws(".", *c)
    item = lambda df, k, raw, static: df.select(k.cast("string").alias("sourceFileId"), raw.alias("raw"), F.lit(static).alias("static"))
    k = F.col("n_nationkey").cast("long")
    work = item(s, F.col("s_suppkey"), dot("packageName", "n_name", "inner"), False)
    for base, raw, static in ((1000000, dot("packageName", "n_name"), False), (2000000, dot("packageName", "n_name", F.lit("MAX")), True), (3000000, dot("packageName", F.lit("A.B.C")), False), (4000000, dot(F.lit("q"), "n_name"), False)):
        work = work.unionByName(item(j, k + base, raw, static))
    work = work.select("sourceFileId", F.concat(F.col("raw"), F.lit("|"), F.col("static").cast("string")).alias("referenceId"), F.lit("java-import").alias("workKind"), "raw", "static", F.lit(False).alias("wildcard"))
    return G.resolve_java(work, nodes, symbols).select(F.col("sourceFileId").cast("long").alias("k"), "status", "reason", F.col("targetId").alias("target"))


@query("""
WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT host AS literal, 'bare' AS module_kind FROM p UNION ALL SELECT 'node:' || host, 'node-builtin' FROM p
""")
def external_modules(spark, sf_dir) -> DataFrame:
    host = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("raw"))
    work = host.unionByName(host.select(F.concat(F.lit("node:"), "raw").alias("raw"))).select("raw", F.lit("javascript").alias("language"), F.lit("tsjs-import").alias("workKind"))
    return G.external_modules(work).select(F.col("literalSpecifier").alias("literal"), F.col("moduleKind").alias("module_kind"))


@query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def endpoint_check(spark, sf_dir) -> DataFrame:
    """Edges (from each document to its label) whose end is missing from the nodes."""
    return G.missing_ends(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


# State.

_LAST = "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq, count(*) AS applied FROM events GROUP BY user_id"
_KIND = "CASE event_type WHEN 'click' THEN 'change' WHEN 'view' THEN 'change' WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'unlink' ELSE 'read-error' END"


def _outcomes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Base (every third user known) and the outcome of each user's last event."""
    last = ST.last_events(changes(table(spark, sf_dir, "events")), ["seq"])
    outcome = F.when(F.col("event") == "unlink", "unlink").when(F.col("event") == "read-error", "read-error").otherwise("indexed")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    base = users.where(F.col("user_id") % 3 == 0).select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.lit("h0").alias("hash"))
    return base, last.select("path", outcome.alias("outcome"), F.when(F.col("seq") % 2 == 0, F.lit("h0")).otherwise(F.concat(F.lit("h"), F.col("seq").cast("string"))).alias("hash"))


_APPLIED = f"""
l AS ({_LAST}), o AS (SELECT user_id, {_KIND} AS kind, CASE WHEN seq % 2 = 0 THEN 'h0' ELSE 'h' || seq END AS new_hash, CASE WHEN user_id % 3 = 0 THEN 'h0' END AS base FROM l),
r AS (
  SELECT 'user/' || user_id AS path, CASE kind WHEN 'read-error' THEN base WHEN 'unlink' THEN NULL ELSE new_hash END AS hash,
         CASE WHEN kind = 'unlink' THEN CASE WHEN base IS NOT NULL THEN 'deleted' END WHEN kind <> 'read-error' AND new_hash IS DISTINCT FROM base THEN new_hash END AS dirty, kind = 'read-error' AS pending FROM o)"""


@query(f"WITH {_APPLIED} SELECT * FROM r")
def overlay_apply(spark, sf_dir) -> DataFrame:
    return ST.apply_outcomes(*_outcomes(spark, sf_dir))


@query(f"WITH {_APPLIED} SELECT CASE WHEN count(*) FILTER (pending) > 0 THEN 'stale' WHEN count(dirty) > 0 THEN 'dirty' ELSE 'fresh' END AS freshness, count(*) FILTER (pending) AS pending, count(dirty) AS dirty FROM r")
def freshness(spark, sf_dir) -> DataFrame:
    state = ST.apply_outcomes(*_outcomes(spark, sf_dir)).agg(F.count_if("pending").alias("pending"), F.count("dirty").alias("dirty"))
    return state.select(ST.freshness(0, F.col("pending"), 0, 0, 0, F.col("dirty")).alias("freshness"), "pending", "dirty")


@query(f"WITH {_APPLIED} SELECT sha256('no-head' || coalesce(string_agg(chr(0) || path || chr(0) || dirty, '' ORDER BY encode(path)), '')) AS revision FROM r WHERE dirty IS NOT NULL")
def workspace_revision(spark, sf_dir) -> DataFrame:
    return ST.revision("no-head", ST.apply_outcomes(*_outcomes(spark, sf_dir)).select("path", F.col("dirty").alias("hash")))


@query("""
WITH g AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS generation, CAST(sum(o_custkey) AS BIGINT) AS bytes FROM orders GROUP BY 1),
a AS (SELECT max(generation) - 2 AS active, CAST(sum(bytes) // 10 AS BIGINT) AS quota FROM g),
r AS (SELECT g.*, active, quota, row_number() OVER (ORDER BY generation DESC) AS place, sum(bytes) OVER (ORDER BY generation DESC ROWS UNBOUNDED PRECEDING) AS total FROM g, a)
SELECT generation, bytes, generation >= active OR (place <= 12 AND total <= quota) AS kept FROM r
""")
def generation_prune(spark, sf_dir) -> DataFrame:
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    g = table(spark, sf_dir, "orders").groupBy(month.alias("generation")).agg(F.sum("o_custkey").alias("bytes"))
    row = g.agg(F.max("generation").alias("m"), F.sum("bytes").alias("b")).first()
    return ST.pruned(g, (row["m"] or 0) - 2, retention=12, quota=(row["b"] or 0) // 10)


@query("""
WITH w AS (SELECT 'u/' || user_id AS path, CASE event_type WHEN 'error' THEN 'read-error' ELSE 'parse-error' END AS code FROM events WHERE event_type IN ('error', 'purchase')),
d AS (SELECT CASE code WHEN 'read-error' THEN 'error' ELSE 'warning' END AS severity, code, path, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY code, encode(path)) AS place, count(*) OVER (PARTITION BY severity) AS total, CASE severity WHEN 'error' THEN 32 ELSE 128 END AS most FROM d)
SELECT severity, code, path, n AS occurrence_count, CAST(0 AS BIGINT) AS omitted FROM r WHERE total <= most OR place <= most - 1
UNION ALL SELECT DISTINCT severity, 'diagnostics-truncated', NULL, 1, total - most + 1 FROM r WHERE total > most
""")
def diagnostics_bound(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    w = e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_type") == "error", "read-error").otherwise("parse-error").alias("code"))
    return ST.bounded(ST.diagnostics(w)).select("severity", "code", "path", F.col("occurrenceCount").alias("occurrence_count"), F.coalesce("omittedCount", F.lit(0)).alias("omitted"))


@query(f"""
WITH d AS (SELECT {DOC_PATH} AS path, doc_id, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
u AS (
  SELECT path, 0 AS priority, doc_id AS rank, 3.0::DOUBLE AS score FROM d WHERE toxic = 1
  UNION ALL SELECT path, 1, doc_id, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 2.0 END FROM d WHERE doc_id % 2 = 0 AND coalesce(quality, 1) <> 0
  UNION ALL SELECT path, 2, doc_id, 1.0 FROM d WHERE doc_id % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority, rank) AS place FROM u)
SELECT path, rank, score, CAST(priority AS INTEGER) AS priority FROM f WHERE place = 1 ORDER BY priority, rank, path LIMIT 100
""")
def live_merge(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").select(document_path().alias("path"), "doc_id").join(labels, "doc_id", "left")
    rows = lambda where, score: d.where(where).select("path", F.col("doc_id").alias("rank"), F.lit(score).alias("score"))
    return M.live_merge(rows("toxic = 1", 3.0), rows("doc_id % 2 = 0", 2.0), rows("doc_id % 5 = 0", 1.0), d.where("quality = 0"), 100)


COUNTERS = {"clicks": "event_type = 'click'", "errors": "event_type = 'error'", "large": "value > 100", "unread": "event_type = 'error' AND value <= 100"}


@query("SELECT user_id % 10 AS shard, " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in COUNTERS.items()) + " FROM events GROUP BY 1")
def telemetry_counts(spark, sf_dir) -> DataFrame:
    return ST.counters(table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 10), COUNTERS, ["shard"])


# Streaming.


def _folder(spark) -> str:
    """A new folder for a stream's progress and output: below the shared checkpoint folder where one is set."""
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="cairn-stream-")


def _event_stream(spark, sf_dir) -> DataFrame:
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "events").schema)
    return C.read_changes(spark, sf_dir, kind, files="events.parquet")


@query(f"SELECT 'user/' || user_id AS path, seq, {_KIND} AS event, applied FROM ({_LAST})")
def stream_overlay(spark, sf_dir) -> DataFrame:
    return C.drain(C.latest(changes(_event_stream(spark, sf_dir))), _folder(spark), "update", ["path"], "seq")


@query(f"SELECT event, count(*) AS n FROM (SELECT {_KIND} AS event FROM events) GROUP BY event")
def stream_counts(spark, sf_dir) -> DataFrame:
    return C.drain(C.counts(changes(_event_stream(spark, sf_dir)), "event"), _folder(spark), "update", ["event"], None)


# Tables that carry identities.


@query("SELECT n_nationkey, 'sha256:' || sha256('{\"row\":{\"name\":\"' || n_name || '\",\"typeOnly\":false},\"rowDigestSchema\":\"repo-map-row/v1\",\"rowKind\":\"export\"}') AS digest FROM nation")
def row_digests(spark, sf_dir) -> DataFrame:
    row = F.struct(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("typeOnly"))
    return table(spark, sf_dir, "nation").select("n_nationkey", I.row_digest(F.struct(row.alias("row"), F.lit("repo-map-row/v1").alias("rowDigestSchema"), F.lit("export").alias("rowKind"))).alias("digest"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS ordinal FROM orders)
SELECT o_orderkey, ordinal FROM o
""")
def occurrence_ordinals(spark, sf_dir) -> DataFrame:
    """Equal descriptors of one owner count up in recorded order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", G.occurrence("o_orderkey", "o_custkey", "o_orderpriority").cast("long").alias("ordinal"))
