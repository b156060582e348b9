"""URL filters by rules and by a path-template tree (DataFrame operations only).

Explicit rules decide first.  The pages that they decide also label the others.  Per host, paths of any depth become
branches of segments, in which numbers, hex strings and numbered files are wildcards.

1. Variable segments: a segment that has less than ``RARE`` of the host's pages at its depth becomes ``*``.
2. Similar branches: under each parent, on all levels, the labels of a child are held against those of its siblings
   by a two-sample test of proportions.  Children that don't differ at ``Z`` are merged into one, written ``+``; their
   counts are pooled.  Each decision needs only counts, so all levels are decided at once.
3. Templates: purity is smoothed down the tree, (blocked + SMOOTH * purity of the parent) / (labelled + SMOOTH), from 0
   above the host, so branches without labels inherit their parent's.  ``REJECT`` or more rejects a template.

Scale.  Pages are reduced to distinct branches with partial aggregation before anything else; the tree works on
branches and their levels.  Every join is an equi-join with one row a key on one side, above plain exchanges, so that
a host with any share of the pages can be split at run time; no window gathers a host, lists hold one branch's levels.

Defined results: a null url or one without ``://`` has empty host and path and is judged by that branch; of equally
long fitting rules the blocking one wins; empty tables give empty results; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, UPPER, checkpoint, table

# The contract's rules (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: A segment is variable below one of so many of a host's pages.
RARE = 50
Z = 1.96
SMOOTH = 2.0
REJECT = 0.5


def with_host_and_path(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ranked]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(segment: Column) -> Column:
    """Numbers, hex strings and numbered files as wildcards; other segments as they are."""
    return (
        F.when(F.rlike(segment, F.lit(r"^[0-9]+$")), F.lit("{n}"))
        .when(F.rlike(segment, F.lit(r"^[0-9]+\.[A-Za-z0-9]+$")), F.regexp_replace(segment, r"^[0-9]+", "{n}"))
        .when(F.rlike(segment, F.lit(r"^[0-9a-fA-F-]{16,}$")), F.lit("{h}"))
        .otherwise(segment)
    )


def _segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), shape)


def _name(segments: Column) -> Column:
    """A short name of a host's branch; segments hold no slash."""
    return F.md5(F.concat(F.col("host"), F.lit("\n"), F.array_join(segments, "/")).cast("binary"))


def _levels(branches: DataFrame, key: str, segments: str, *columns: str) -> DataFrame:
    """``key, host, _url_k, _url_s, _url_up`` and ``columns``: a row for each segment, with the name of what is above it."""
    chained = lambda above, x: F.concat(above, F.array(F.md5(F.concat(F.element_at(above, -1), F.lit("/"), x).cast("binary"))))
    names = F.aggregate(segments, F.array(F.md5(F.col("host").cast("binary"))), chained)
    level = lambda x, k: F.struct(k.alias("k"), x.alias("s"), F.element_at("_url_names", k + 1).alias("up"))
    each = branches.withColumn("_url_names", names).select(key, "host", *columns, F.explode(F.transform(segments, level)).alias("_url_l"))
    return each.select(key, "host", *columns, F.col("_url_l.k").alias("_url_k"), F.col("_url_l.s").alias("_url_s"), F.col("_url_l.up").alias("_url_up"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that keeps the left keys."""
    right = right.withColumnsRenamed({k: f"_url_r_{k}" for k in keys})
    return left.join(right, [F.col(k) == F.col(f"_url_r_{k}") for k in keys], how).drop(*[f"_url_r_{k}" for k in keys])


def _relabelled(branches: DataFrame, key: str, levels: DataFrame, label: Column, out: str) -> DataFrame:
    """``branches`` plus ``out``: their segments, named anew by ``label`` of each level."""
    lists = levels.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_url_k", label.alias("t")))), lambda x: x["t"]).alias(out))
    return _joined(branches, lists, [key], "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


_SUMS = ("n", "blocked", "labelled")


def _pooled(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])


def templates(branches: DataFrame) -> DataFrame:
    """For each branch (``branch, host, segments, n, blocked, labelled``): its template and whether that is rejected."""
    # 1. Segments that are rare among the host's pages of that depth.
    levels = _levels(branches, "branch", "segments", "n")
    values = levels.groupBy("host", "_url_k", "_url_s").agg(F.sum("n").alias("_url_n"))
    pages = levels.groupBy("host", "_url_k").agg(F.sum("n").alias("_url_all"))
    rare = _joined(values, pages, ["host", "_url_k"]).where(F.col("_url_n") * RARE < F.col("_url_all")).select("host", "_url_k", "_url_s", F.lit(True).alias("_url_rare"))
    levels = _joined(levels, rare, ["host", "_url_k", "_url_s"], "left")
    known = _relabelled(branches, "branch", levels, F.when(F.col("_url_rare"), F.lit("*")).otherwise(F.col("_url_s")), "_url_general")
    known = checkpoint(known.withColumn("_url_group", _name(F.col("_url_general"))))

    # 2. Children whose labels differ from their siblings'.
    groups = _pooled(known, "_url_group", "host", "_url_general")
    levels = _levels(groups, "_url_group", "_url_general", *_SUMS)
    children = _pooled(levels, "_url_up", "_url_s")
    families = children.groupBy("_url_up").agg(F.sum("blocked").cast("double").alias("_url_b"), F.sum("labelled").cast("double").alias("_url_a"))
    b, a = F.col("blocked").cast("double"), F.col("labelled").cast("double")
    all_b, all_a = F.col("_url_b"), F.col("_url_a")
    gap, share = b / a - (all_b - b) / (all_a - a), all_b / all_a
    differs = (a > 0) & (all_a > a) & (gap * gap > Z * Z * share * (1 - share) * (1 / a + 1 / (all_a - a)))
    marked = _joined(children, families, ["_url_up"]).where(differs).select("_url_up", "_url_s", F.lit(True).alias("_url_own"))
    levels = _joined(levels, marked, ["_url_up", "_url_s"], "left")
    groups = _relabelled(groups, "_url_group", levels, F.when(F.col("_url_own"), F.col("_url_s")).otherwise(F.lit("+")), "_url_merged")
    groups = checkpoint(groups.withColumn("_url_template", _name(F.col("_url_merged"))))

    # 3. Purity of each template, smoothed from the host down.
    merged = _pooled(groups, "_url_template", "host", "_url_merged")
    # Each level's own name is the name above an end that is put behind it.
    levels = _levels(merged.withColumn("_url_merged", F.concat("_url_merged", F.array(F.lit("")))), "_url_template", "_url_merged", "blocked", "labelled")
    counts = levels.groupBy("_url_up").agg(F.sum("blocked").cast("double").alias("_url_b"), F.sum("labelled").cast("double").alias("_url_a"))
    path = _joined(levels.select("_url_template", "_url_k", "_url_up"), counts, ["_url_up"])
    lists = path.groupBy("_url_template").agg(F.array_sort(F.collect_list(F.struct("_url_k", "_url_b", "_url_a"))).alias("_url_path"))
    purity = F.aggregate("_url_path", F.lit(0.0), lambda p, x: (x["_url_b"] + F.lit(SMOOTH) * p) / (x["_url_a"] + F.lit(SMOOTH)))
    judged = lists.select("_url_template", (purity >= REJECT).alias("reject"))

    template = F.concat(F.lit("/"), F.array_join("_url_merged", "/")).alias("template")
    groups = _joined(groups.select("_url_group", "_url_template", template), judged, ["_url_template"]).select("_url_group", "template", "reject")
    return _joined(known.select("branch", "_url_group"), groups, ["_url_group"]).select("branch", "template", "reject")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` of every row of ``pages`` (page_id, url)."""
    judged = with_host_and_path(pages.select("page_id", "url")).drop("url").withColumn("_url_rule", rule_for(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("segments", _segments(F.col("path"))).withColumn("branch", _name(F.col("segments")))
    blocked = (F.col("_url_rule.verdict") == "block").cast("long")
    branches = judged.groupBy("branch").agg(
        F.first("host").alias("host"), F.first("segments").alias("segments"), F.count("*").alias("n"), F.sum(F.coalesce(blocked, F.lit(0))).alias("blocked"), F.count("_url_rule").alias("labelled")
    )
    out = _joined(judged.drop("segments"), templates(checkpoint(branches)), ["branch"])
    verdict = F.coalesce(F.col("_url_rule.verdict"), F.when(F.col("reject"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_url_rule.rule").alias("rule"), verdict.alias("verdict"), "template")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract of op6 over all of ``pages``; ``template`` follows."""
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


OP6_SQL = r"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/' END AS rule,
         list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
           CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '{n}' WHEN regexp_matches(x, '^[0-9]+\.[A-Za-z0-9]+$') THEN regexp_replace(x, '^[0-9]+', '{n}')
                WHEN regexp_matches(x, '^[0-9a-fA-F-]{16,}$') THEN '{h}' ELSE x END) AS seg FROM p),
s AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS blk FROM r),
b AS (SELECT host, seg, count(*) AS n, coalesce(sum(blk), 0) AS bl, count(blk) AS la FROM s GROUP BY ALL),
l1 AS (SELECT host, seg, n, unnest(range(1, len(seg) + 1)) AS k, unnest(seg) AS x FROM b),
v1 AS (SELECT host, k, x, n * 50 < sum(n) OVER (PARTITION BY host, k) AS rare FROM (SELECT host, k, x, sum(n) AS n FROM l1 GROUP BY ALL)),
g1 AS (SELECT host, seg, list(CASE WHEN rare THEN '*' ELSE x END ORDER BY k) AS gen FROM l1 JOIN v1 USING (host, k, x) GROUP BY host, seg),
b1 AS (SELECT b.*, coalesce(gen, []) AS gen FROM b LEFT JOIN g1 USING (host, seg)),
b2 AS (SELECT host, gen, sum(bl) AS bl, sum(la) AS la FROM b1 GROUP BY ALL),
l2 AS (SELECT host, gen, bl, la, k, gen[k] AS x, array_to_string(gen[1 : k - 1], '/') AS up FROM (SELECT *, unnest(range(1, len(gen) + 1)) AS k FROM b2)),
c2 AS (SELECT host, up, x, sum(bl)::DOUBLE AS b, sum(la)::DOUBLE AS a FROM l2 GROUP BY ALL),
w2 AS (SELECT *, sum(b) OVER w AS tb, sum(a) OVER w AS ta FROM c2 WINDOW w AS (PARTITION BY host, up)),
d2 AS (
  SELECT host, up, x, CASE WHEN a > 0 AND ta > a
    THEN (b / a - (tb - b) / (ta - a)) * (b / a - (tb - b) / (ta - a)) > 1.96::DOUBLE * 1.96::DOUBLE * (tb / ta) * (1 - tb / ta) * (1 / a + 1 / (ta - a)) ELSE false END AS own FROM w2),
g2 AS (SELECT host, gen, list(CASE WHEN own THEN x ELSE '+' END ORDER BY k) AS tpl FROM l2 JOIN d2 USING (host, up, x) GROUP BY host, gen),
b3 AS (SELECT b2.*, coalesce(tpl, []) AS tpl FROM b2 LEFT JOIN g2 USING (host, gen)),
b4 AS (SELECT host, tpl, sum(bl) AS bl, sum(la) AS la FROM b3 GROUP BY ALL),
l4 AS (SELECT host, tpl, bl, la, j, array_to_string(tpl[1 : j], '/') AS pre FROM (SELECT *, unnest(range(0, len(tpl) + 1)) AS j FROM b4)),
c4 AS (SELECT host, pre, sum(bl)::DOUBLE AS b, sum(la)::DOUBLE AS a FROM l4 GROUP BY ALL),
q4 AS (SELECT host, tpl, list([b, a] ORDER BY j) AS way FROM l4 JOIN c4 USING (host, pre) GROUP BY host, tpl),
t4 AS (SELECT host, tpl, list_reduce(list_prepend([0.0::DOUBLE], way), lambda p, x: [(x[1] + 2.0::DOUBLE * p[1]) / (x[2] + 2.0::DOUBLE)])[1] >= 0.5 AS reject FROM q4)
SELECT page_id, host, path, rule, CASE WHEN blk = 1 THEN 'block' WHEN blk = 0 THEN 'allow' WHEN reject THEN 'block' ELSE 'allow' END AS verdict, '/' || array_to_string(tpl, '/') AS template
FROM s JOIN b1 USING (host, seg) JOIN b3 USING (host, gen) JOIN t4 USING (host, tpl)
"""
