"""URL filter: fixed rules, and for urls without one a tree of path templates judged by the rules' own labels.

Per host, paths are cut into segments; numbers, dates and hexadecimal names become classes. The tree grows from the
root, for all hosts at once; what all paths of a node begin with is one step, so a level of the tree is a level of
branches, however deep the paths are. Under each node

- segments with few pages become {var};
- segments with labelled pages stand in order of their share of blocked ones, and neighbours in that order that do not
  differ (two-proportion test) merge: {like0}, {like1} ... in rising order; one that differs from both keeps its name;
- segments without labelled pages, among which nothing can differ, merge into {unlabelled}.

A node with fewer pages than a segment needs grows no further; what is left of its paths is {rest}.

A template's purity is its share of blocked pages among the labelled ones, smoothed towards what its node inherits: the
node's own share, where unlabelled pages count as the prior, smoothed in the same way up to the root. A template with a
purity over a half is rejected.

Everything is counted by partial aggregation over distinct paths, so that a host with a third of all pages is no task's
burden; shares are rounded to thousandths before they are ordered, so that a node has at most 1001 of them. Null urls and
urls without :// have an empty host and path, no rule, and are allowed: there is no host whose tree could judge them.
Repeated rows and ids are judged each; ties in the share are one share. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only, table, tidied

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_SUPPORT = 8
Z = 1.96
PRIOR, PRIOR_WEIGHT = 0.1, 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """A path's segments, variable ones as classes."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.regexp_replace(
            F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("{date}")).when(s.rlike(r"^(?=.*\d)[0-9a-fA-F]{8,}$") & ~s.rlike(r"^\d+$"), F.lit("{hex}")).otherwise(s), r"\d+", "{n}"
        ),
    )


def common_start(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda s, same: F.struct((s["n"] + (s["open"] & same).cast("int")).alias("n"), (s["open"] & same).alias("open"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), start, step, lambda s: s["n"])


def similar_branches(children: DataFrame, z: float) -> DataFrame:
    """children (host, template, child, n_labelled, n_blocked) with labelled pages: with name, the same for neighbours in order of their share of blocked pages that do not differ."""
    rated = children.withColumn("share", F.round(F.col("n_blocked") / F.col("n_labelled"), 3))
    shares = rated.groupBy("host", "template", "share").agg(F.sum("n_labelled").alias("n"), F.sum("n_blocked").alias("b"), F.count(F.lit(1)).alias("k"), F.min("child").alias("child"))
    order = Window.partitionBy("host", "template").orderBy("share")
    n, b = F.lag("n").over(order), F.lag("b").over(order)
    pooled = (F.col("b") + b) / (F.col("n") + n)
    differs = F.abs(F.col("b") / F.col("n") - b / n) >= z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / n))
    marked = shares.withColumn("new", F.coalesce(differs, F.lit(False)).cast("int")).withColumn("group", F.sum("new").over(order))
    sizes = marked.groupBy("host", "template", "group").agg(F.sum("k").alias("size"), F.min("child").alias("only"))
    name = F.when(F.col("size") == 1, F.col("only")).otherwise(F.concat(F.lit("{like"), F.col("group"), F.lit("}")))
    named = marked.join(sizes, ["host", "template", "group"]).select("host", "template", "share", name.alias("name"))
    return rated.join(named, ["host", "template", "share"]).select("host", "template", "child", "name")


def template_tree(pages: DataFrame, min_support: int = MIN_SUPPORT, z: float = Z, prior: float = PRIOR, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """pages (host, segs, label: 1 blocked, 0 allowed, null unlabelled): host, segs, template, and the template's n_pages, n_labelled, n_blocked, purity."""
    return tidied("url-tree", lambda: grown_tree(pages, min_support, z, prior, weight))


def grown_tree(pages: DataFrame, min_support: int, z: float, prior: float, weight: float) -> DataFrame:
    counted = pages.where(F.col("host") != "").groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("n_blocked"))
    sums = [F.sum(c).alias(c) for c in ("n", "n_labelled", "n_blocked")]
    open_ = materialize(counted.withColumns({"template": F.lit(""), "rest": F.col("segs"), "inherited": F.lit(prior)}), "url-tree")
    columns, done = [*counted.columns, "template", "inherited"], []
    left = F.slice("rest", F.col("shared") + 1, F.size("rest"))
    grown_by = F.array_join(F.concat(F.array("template"), F.slice("rest", F.lit(1), F.col("shared"))), "/")
    while not open_.isEmpty():
        # what is read several times is written, which also lets Spark split a host or a branch with many paths when it is joined
        nodes = open_.groupBy("host", "template").agg(*sums, F.first("inherited").alias("inherited"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        value = (F.col("n_blocked") + weight * F.col("inherited") + prior * (F.col("n") - F.col("n_labelled"))) / (F.col("n") + weight)
        value = F.when(F.col("lo") == F.col("hi"), F.col("inherited")).otherwise(value)  # all paths end here: a template of its own, below the node before
        nodes = nodes.select("host", "template", (F.col("n") < min_support).alias("small"), value.alias("value"), common_start(F.col("lo"), F.col("hi")).alias("shared"))
        stepped = open_.join(nodes, ["host", "template"]).withColumns({
            "template": F.when(F.col("small"), F.concat_ws("/", "template", F.lit("{rest}"))).otherwise(grown_by), "inherited": F.when(F.col("small"), F.col("inherited")).otherwise(F.col("value")),
            "rest": left, "child": F.coalesce(F.get(left, F.lit(0)), F.lit("")),
        })
        stepped = materialize(stepped.select(*columns, "rest", "child", "small"), "url-steps")
        done.append(stepped.where("small").select(columns))
        stepped = stepped.where("not small").drop("small")
        children = stepped.groupBy("host", "template", "child").agg(*sums)
        is_class = F.col("child").startswith("{") | (F.col("child") == "")
        tested = ~is_class & (F.col("n") >= min_support) & (F.col("n_labelled") > 0)
        plain = F.when(is_class, F.col("child")).when(F.col("n") < min_support, "{var}").otherwise("{unlabelled}")
        named = children.where(~tested).select("host", "template", "child", plain.alias("name")).unionByName(similar_branches(children.where(tested), z))
        grown = stepped.join(materialize(named, "url-names"), ["host", "template", "child"]).withColumn("template", F.concat_ws("/", "template", "name"))
        grown = materialize(grown.select(*columns, "child", F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "url-tree")
        done.append(grown.where("child = ''").select(columns))
        open_ = grown.where("child <> ''").drop("child")
    tree = materialize(reduce(DataFrame.unionByName, done, open_.select(columns)), "url-templates")
    stats = tree.groupBy("host", "template").agg(F.sum("n").alias("n_pages"), F.sum("n_labelled").alias("t_labelled"), F.sum("n_blocked").alias("t_blocked"), F.first("inherited").alias("t_inherited"))
    purity = (F.col("t_blocked") + weight * F.col("t_inherited")) / (F.col("t_labelled") + weight)
    stats = materialize(stats.withColumn("purity", purity), "url-stats")
    return tree.select("host", "segs", "template").join(stats, ["host", "template"]).withColumnsRenamed({"t_labelled": "n_labelled", "t_blocked": "n_blocked"}).drop("t_inherited")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, prior: float = PRIOR, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """pages (page_id, url): page_id, host, path, rule, verdict, template, purity (the template's smoothed share of blocked pages)."""
    host, path = host_and_path(F.col("url"))
    parsed = only(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("segs"))
    tree = template_tree(parsed.select("host", "segs", (F.col("ruled") == "block").cast("int").alias("label")), prior=prior, weight=weight)
    learned = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    judged = tree.select("host", "segs", "template", "purity")
    return parsed.join(judged, ["host", "segs"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "purity")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9}
ORACLES: dict[str, str] = {}
