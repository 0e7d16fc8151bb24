"""URL filter by a path-template tree.

Per host, path segments become classes (numbers, hex strings), rare siblings
become ``*``, and siblings whose share of bad labels doesn't differ (two-
proportion z test) merge into ``*``. A template is rejected if its smoothed
labelled purity, drawn to its host's and that to the corpus's, is under a
threshold. The tree is made level by level with grouped sums, so that no host
is gathered in one task.

Defined results: a null URL, or one without ``://``, has empty host and path
and is judged as such a host; labels of unknown pages are ignored, repeated
labels count once (bad if any is); without labels every template is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEPTH = 4
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, _SPLIT, 1)), F.regexp_extract(u, _SPLIT, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in reversed(best):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    """Array of exactly ``depth`` segments by class; the last one holds whatever is deeper, '' stands for none."""
    cut = F.split(F.regexp_replace(path, "^/", ""), "/", depth)
    cls = lambda s: (
        F.when(s.rlike(r"^[0-9]+$"), "{n}")
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), "{h}")
        .when(F.length(s) > 40, "{s}")
        .otherwise(s)
    )
    return F.array(*[F.coalesce(cls(F.get(cut, F.lit(i))), F.lit("")) for i in range(depth)])


def _level(table: DataFrame, i: int, rare: int, many: int, z: float) -> DataFrame:
    """Generalises segment i below each prefix of the segments before it."""
    keys = ["host", *(f"s{j}" for j in range(i))]
    child = table.groupBy(*keys, f"s{i}").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    above = child.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("good").alias("g_all"), F.sum("bad").alias("b_all"))
    seen, rest = F.col("good") + F.col("bad"), F.col("g_all") + F.col("b_all") - F.col("good") - F.col("bad")
    pool = F.col("b_all") / F.nullif(F.col("g_all") + F.col("b_all"), F.lit(0))
    gap = F.abs(F.col("bad") / F.nullif(seen, F.lit(0)) - (F.col("b_all") - F.col("bad")) / F.nullif(rest, F.lit(0)))
    error = F.sqrt(pool * (1 - pool) * (1 / F.nullif(seen, F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
    differs = F.coalesce((seen >= 5) & (rest >= 5) & (gap > z * error), F.lit(False))
    wild = (F.col(f"s{i}") != "") & (F.col("k") > 1) & (((F.col("k") > many) & (F.col("n") < rare)) | ~differs)
    named = child.join(above, keys).select(*keys, f"s{i}", F.when(wild, "*").otherwise(F.col(f"s{i}")).alias("_to"))
    return table.join(named, [*keys, f"s{i}"]).withColumn(f"s{i}", F.col("_to")).drop("_to")


def fit(urls: DataFrame, labels: DataFrame, depth: int = DEPTH, rare: int = 8, many: int = 16, z: float = 2.58, weight: float = 2.0, least: float = 0.5) -> DataFrame:
    """Templates from urls (page_id, host, segs) and labels (page_id, bad): host, segs (as classed), template, n, good, bad, purity, rejected."""
    marks = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = (
        urls.join(marks, "page_id", "left")
        .groupBy("host", "segs")
        .agg(F.count("*").alias("n"), F.sum(F.when(F.col("bad") == 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad") == 1, 1).otherwise(0)).alias("bad"))
    )
    table = materialise(counts.select("host", "segs", "n", "good", "bad", *[F.col("segs")[j].alias(f"s{j}") for j in range(depth)]), "url-branches")
    for i in range(depth):
        table = materialise(_level(table, i, rare, many, z), f"url-level-{i}")
    table = table.withColumn("template", F.concat_ws("/", *[f"s{j}" for j in range(depth)]))
    table = materialise(table.select("host", "segs", "template", "n", "good", "bad"), "url-tree")
    every = table.agg(F.sum("good").alias("g0"), F.sum("bad").alias("b0"))
    hosts = table.groupBy("host").agg(F.sum("good").alias("gh"), F.sum("bad").alias("bh"))
    found = table.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    p0 = (F.col("g0") + 1) / (F.col("g0") + F.col("b0") + 1)
    ph = (F.col("gh") + weight * p0) / (F.col("gh") + F.col("bh") + weight)
    scored = (
        found.join(hosts, "host").crossJoin(F.broadcast(every))  # one row
        .withColumn("purity", (F.col("good") + weight * ph) / (F.col("good") + F.col("bad") + weight))
        .select("host", "template", "n", "good", "bad", "purity", (F.col("purity") < least).alias("rejected"))
    )
    return materialise(table.select("host", "segs", "template").join(scored, ["host", "template"]), "url-templates")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, depth: int = DEPTH, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every page (page_id, url); labels: (page_id, bad)."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("segs", segments(F.col("path"), depth))
    tree = fit(urls.select("page_id", "host", "segs"), labels, depth, **how).select("host", "segs", "template", "purity", "rejected")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("rejected"), "block").otherwise("allow"))
    return urls.join(tree, ["host", "segs"], "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "purity")
