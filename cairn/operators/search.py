"""Indexed search: eight-field BM25+ with exact, prefix and fuzzy terms, feature re-ranking, top k.

``build_index`` tokenises a file table once and stores three tables: the files, postings ``(path, field, term, tf,
len)`` and the vocabulary ``(field, term, df)``; any number of queries run on them.  A query is a few short strings on
the driver; the vocabulary is matched by a projection with the query's terms as literals (no join), postings of
matching terms are found by an equi-join that Spark broadcasts only below its size threshold, and sums are combined
before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators.materialise import stored

# Boosts and constants of the score.
BOOSTS = {"symbols": 6.0, "exports": 5.0, "pathAliases": 4.0, "fileName": 3.0, "path": 2.5, "signatures": 2.0, "imports": 1.5, "terms": 1.0}
K1, B, D = 1.2, 0.7, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT, PREFIX_DECAY = 0.375, 0.45, 0.3
FUZZY_SHARE, MAX_FUZZY = 0.15, 6
NOISE = {"vendor": 0.35, "minified": 0.3, "locale-catalog": 0.4}
MAX_REASONS = 5


@dataclass
class Index:
    """The stored tables, the mean length of each field and the number of files."""

    files: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    averages: dict[str, float]
    n: int


def documents(files: DataFrame) -> DataFrame:
    """``path, field, text``: the eight indexed texts of each file."""
    names = lambda c, f: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast(files.schema[c].dataType)), f), " ")
    texts = {
        "path": F.col("path"),
        "fileName": T.base_name("path"),
        "pathAliases": F.array_join(T.path_aliases("path", "packageName", F.transform("symbols", lambda s: s["name"])), " "),
        "symbols": names("symbols", lambda s: s["name"]),
        "signatures": names("symbols", lambda s: s["signature"]),
        "exports": names("exports", lambda e: e["name"]),
        "imports": names("imports", lambda i: F.array_join(F.concat(F.array(i["source"]), i["names"]), " ")),
        "terms": F.array_join(F.coalesce("lexicalTerms", F.array().cast("array<string>")), " "),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("text")) for k, v in texts.items()])).alias("d")
    return files.select("path", pairs).select("path", "d.field", "d.text")


def postings(docs: DataFrame) -> DataFrame:
    """``path, field, term, tf, len, opens``: tf counts spellings that fall together in lower case, len distinct spellings;
    ``opens`` marks one posting of each text.

    A text's tokens are counted within its row, so nothing is shuffled: spellings that fall together are neighbours
    in sorted order.
    """
    tokens = docs.select("path", "field", F.transform(T.linked_tokens("text"), F.lower).alias("t"))
    tokens = tokens.select("path", "field", F.size("t").alias("len"), F.array_distinct("t").alias("u"), "t")
    ordered = tokens.select("path", "field", "len", F.when(F.size("u") == F.col("len"), F.col("u")).otherwise(F.array_sort("u")).alias("u"), F.when(F.size("u") < F.col("len"), F.array_sort("t")).alias("t"))
    place = lambda i: F.array_position("t", F.element_at("u", i))
    run = lambda x, i: F.when(i + 1 < F.size("u"), place(i + 2)).otherwise(F.col("len") + 1) - F.array_position("t", x)
    counted = F.transform("u", lambda x, i: F.struct(x.alias("term"), F.when(F.col("t").isNull(), F.lit(1).cast("long")).otherwise(run(x, i)).alias("tf")))
    each = ordered.select("path", "field", "len", F.posexplode(counted).alias("at", "p"))
    return each.select("path", "field", "p.term", "p.tf", "len", (F.col("at") == 0).alias("opens"))


def build_index(files: DataFrame) -> Index:
    """Tokenises and stores; ``files`` is read once."""
    files = stored(files)
    found = stored(postings(documents(files)))
    n = files.count()
    lengths = found.where("opens").groupBy("field").agg(F.sum("len").alias("s")).collect()
    averages = dict.fromkeys(BOOSTS, 0.0) if n else {}
    averages |= {r["field"]: r["s"] / n for r in lengths}
    return Index(files, found, stored(found.groupBy("field", "term").agg(F.count("*").alias("df"))), averages, n)


def max_distance(term: str) -> int:
    return min(MAX_FUZZY, int(len(term) * FUZZY_SHARE + 0.5))


def expand(vocabulary: DataFrame, terms: list[str], prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """``vocabulary`` plus ``query_term, weight`` for each of its terms and each query term that it stands for."""

    def match(q: str) -> Column:
        term, size, d = F.col("term"), F.length("term").cast("double"), max_distance(q)
        weight = F.when(term == q, F.lit(1.0))
        if prefix:
            weight = weight.when(term.startswith(q), PREFIX_WEIGHT * size / (size + PREFIX_DECAY * (size - len(q))))
        if fuzzy and d:
            # The length band is tested first; the distance is -1 beyond its limit.
            gap = F.when(F.abs(F.length("term") - len(q)) <= d, F.levenshtein(term, F.lit(q), d))
            weight = weight.when(gap >= 0, FUZZY_WEIGHT * size / (size + gap))
        return F.when(weight.isNotNull(), F.struct(F.lit(q).alias("query_term"), weight.alias("weight")))

    hits = F.filter(F.array(*[match(q) for q in terms]), lambda x: x.isNotNull())
    return vocabulary.select("*", F.explode(hits).alias("h")).select(*vocabulary.columns, "h.query_term", "h.weight")


def bm25(index: Index, query: str, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """``path, score, query_terms`` of every file that matches a term of ``query``."""
    terms = [t.lower() for t in T.query_tokens(query)]
    if not terms:
        return index.files.sparkSession.createDataFrame([], "path string, score double, query_terms array<string>")
    hits = index.postings.join(expand(index.vocabulary, terms, prefix, fuzzy), ["field", "term"])
    boost = reduce(lambda c, x: c.when(F.col("field") == x[0], F.lit(x[1])), BOOSTS.items(), F.when(F.lit(False), F.lit(0.0)))
    average = reduce(lambda c, x: c.when(F.col("field") == x[0], F.lit(float(x[1]))), index.averages.items(), F.when(F.lit(False), F.lit(0.0)))
    idf = F.log1p((F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = D + F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))
    scored = hits.groupBy("path").agg(F.sum(F.col("weight") * boost * idf * tf).alias("raw"), F.array_sort(F.collect_set("query_term")).alias("query_terms"))
    return scored.select("path", (F.col("raw") * F.size("query_terms")).alias("score"), "query_terms")


def candidate_limit(limit: int, n: int) -> int:
    return min(n, max(limit, min(1000, max(100, 20 * limit))))


def _in(column: Column, values: list[str]) -> Column:
    return column.isin(*values) if values else F.lit(False)


def holding(names: Column, terms: list[str]) -> Column:
    """Those of ``names`` that hold one of ``terms`` (lower-case)."""
    held = F.array(*map(F.lit, terms)).cast("array<string>")
    return F.filter(names, lambda n: F.exists(held, lambda t: F.contains(F.lower(n), t)))


def rerank(hits: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """``hits`` (path, score, query_terms) with features: final score, reasons, matched symbols."""
    normal = query.strip().replace("\\", "/").lower()
    identifiers = list(dict.fromkeys(t.lower() for t in T.query_tokens(query)))
    structured = T.query_structured(query)
    searchable = [t for t in identifiers if len(t) >= 2]
    strings = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    row = hits.join(files, "path")
    names = lambda c: F.array_distinct(F.transform(F.filter(c, lambda s: _in(F.lower(s["name"]), identifiers)), lambda s: s["name"]))
    package, symbol_names = F.col("packageName"), F.transform("symbols", lambda s: s["name"])
    row = row.withColumns({
        "_sym": names("symbols"), "_exp": names("exports"),
        "_idn": F.array_intersect(strings(structured), F.transform("lexicalTerms", F.lower)),
        "_qal": F.array_intersect(T.qualified_aliases("path", package, symbol_names), strings(identifiers)),
        "_pth": F.array_contains(F.transform(T.path_aliases("path", package, symbol_names), F.lower), normal),
    })
    covered = F.size(F.array_intersect(strings(searchable), F.col("query_terms")))
    score = F.log1p("score") + (covered / float(len(searchable)) if searchable else F.lit(0.0)) * 3.0
    score = score + F.size("_sym") * 12.0 + F.size("_exp") * 8.0 + F.size("_idn") * 8.0 + F.size("_qal") * 14.0 + F.when(F.col("_pth"), 16.0).otherwise(0.0)
    lower = F.lower("path")
    named = (lower == normal) | (T.base_name(lower) == normal)
    catalog_query = any(x in identifiers for x in T.LOCALE_SEGMENTS) or any(f".{x}" in (normal + " ") and (normal + " ").split(f".{x}", 1)[1][:1].isspace() for x in ("po", "pot", "mo"))
    noise = {
        "vendor": T.is_vendor("path") & ~named & F.lit("vendor" not in identifiers),
        "minified": T.is_minified("path") & ~named & F.lit(".min." not in normal),
        "locale-catalog": T.is_locale_catalog("path") & ~named & F.lit(not catalog_query),
    }
    for kind, factor in NOISE.items():
        score = score * F.when(noise[kind], factor).otherwise(1.0)
    some = lambda label, c: F.when(F.size(c) > 0, T.bounded_reason(label, F.col(c)))
    reasons = [some("exact symbol", "_sym"), some("exact export", "_exp"), some("qualified path", "_qal"), F.when(F.col("_pth"), F.lit("exact path")), some("exact identifier", "_idn")]
    reasons += [F.when(noise[k], F.lit(f"de-boosted {k}")) for k in NOISE] + [some("matched terms", "query_terms")]
    matched = holding(F.transform("symbols", lambda s: s["name"]), searchable)
    return row.select(
        "path", score.alias("score"), "kind", matched.alias("matchedSymbols"),
        F.slice(F.filter(F.array(*reasons), lambda r: r.isNotNull()), 1, MAX_REASONS).alias("matchReasons"), "symbols", "dependencies",
    )


def search(index: Index, query: str, limit: int = 10) -> DataFrame:
    """The ``limit`` best files for ``query``, best first; ties by path."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise ValueError("query limit must be a positive integer")
    hits = bm25(index, query).orderBy(F.col("score").desc(), "path").limit(max(1, candidate_limit(limit, index.n)))
    return rerank(hits, index.files, query).orderBy(F.col("score").desc(), "path").limit(limit)
