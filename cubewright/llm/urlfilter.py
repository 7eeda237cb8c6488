"""URL filter by per-host path-template trees (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segment_shape(seg: Column) -> Column:
    """A segment that varies by its form becomes a wildcard: numbers, dates, long hexadecimal or mixed identifiers."""
    return (
        F.when(F.rlike(seg, F.lit(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$")), "*")
        .when(F.rlike(seg, F.lit(r"^[0-9]{1,4}([-_.][0-9]{1,4})+$")), "*")
        .when(F.rlike(seg, F.lit(r"^[0-9a-fA-F-]{8,}(\.[A-Za-z0-9]{1,5})?$")) & F.rlike(seg, F.lit("[0-9]")), "*")
        .when(F.rlike(seg, F.lit(r"[0-9]{3,}")), "*")
        .otherwise(seg)
    )


def path_form(path: Column) -> Column:
    """What a path looks like, whatever its words: how many segments (four at most), what the last one is, and how it ends."""
    bare = F.regexp_replace(path, "^/+|/+$", "")
    segs = F.split(bare, "/+")
    last = F.element_at(segs, -1)
    kind = (
        F.when(last == "", "none")
        .when(F.rlike(last, F.lit("^[0-9]+$")), "number")
        .when(F.rlike(last, F.lit(r"^[0-9]+\.[A-Za-z0-9]{1,5}$")), "numbered file")
        .when(F.rlike(last, F.lit(r"\.[A-Za-z0-9]{1,5}$")), "file")
        .when(F.rlike(last, F.lit("[0-9]")), "mixed")
        .otherwise("word")
    )
    return F.concat_ws(" ", F.least(F.size(segs), F.lit(4)).cast("string"), kind, F.when(F.endswith(path, F.lit("/")), "slash").otherwise("open"))


def _alike(branches: DataFrame, parent: list[str], child: str, z: float) -> DataFrame:
    """(parent..., child, alike) for every branch of ``branches`` (parent..., child, form, n, labelled, blocked): whether it is
    like all its siblings together, itself left out."""
    own = branches.groupBy(*parent, child).agg(F.sum("n").alias("n1"), F.sum("labelled").alias("l1"), F.sum("blocked").alias("b1"))
    of_form = branches.groupBy(*parent, "form").agg(F.sum("n").alias("nf"))
    all_of = branches.groupBy(*parent).agg(F.sum("n").alias("nn"), F.sum("labelled").alias("ll"), F.sum("blocked").alias("bb"), F.countDistinct("form").alias("forms"))
    # two samples over the forms; cells that only the siblings have add up to n1 / n2 of their rows
    cells = branches.groupBy(*parent, child, "form").agg(F.sum("n").alias("c1")).join(own, [*parent, child]).join(of_form, [*parent, "form"]).join(all_of, parent)
    c1, c2, n1, n2 = F.col("c1"), F.col("nf") - F.col("c1"), F.col("n1"), F.col("nn") - F.col("n1")
    cell = F.when(n2 > 0, F.pow(F.sqrt(n2 / n1) * c1 - F.sqrt(n1 / n2) * c2, F.lit(2)) / (c1 + c2))
    sums = cells.groupBy(*parent, child, "n1", "l1", "b1", "nn", "ll", "bb", "forms").agg(F.sum(cell).alias("x"), F.sum(c2).alias("met"))
    x = F.col("x") + F.when(n2 > 0, n1 / n2 * (n2 - F.col("met")))
    df = F.col("forms") - 1
    same_form = x <= df + z * F.sqrt(2 * df) + 1e-9  # rounding
    l2, b2 = F.col("ll") - F.col("l1"), F.col("bb") - F.col("b1")
    p = (F.col("bb") + 0.5) / (F.col("ll") + 1)
    both = (F.col("l1") > 0) & (l2 > 0)
    same_labels = ~both | (F.abs(F.col("b1") / F.col("l1") - b2 / l2) <= z * F.sqrt(p * (1 - p) * (1 / F.col("l1") + 1 / l2)))
    return sums.select(*parent, child, F.coalesce((n2 > 0) & same_form & F.coalesce(same_labels, F.lit(True)), F.lit(False)).alias("alike"))


def judge(
    pages: DataFrame, rules=RULES, depth: int = 3, distinct: int = 12, varied: float = 0.5, z: float = 2.0, weight: float = 4.0, purity: float = 0.8
) -> DataFrame:
    """Host, path, fitting rule and verdict of every row of ``pages`` (page_id, url).

    Rows that a rule fits are the labelled ones. Of every host a tree of path templates is grown from all its paths, level by level:

    1. Segments that vary by form are wildcards. Under one parent template, if its children are over ``distinct`` names and
       more than ``varied`` of its rows' count, all its children are one wildcard. Segments beyond ``depth`` are one tail.
    2. Siblings that are statistically similar are merged, labelled or not: a branch joins the merged one if the forms of its
       paths are distributed as those of its siblings together, itself left out (two-sample chi-square at most df + z * sqrt(2 df)),
       and, where both have labels, their blocked shares are within ``z`` standard errors.
    3. A merged template's purity is (blocked + weight / 2) / (labelled + weight) over its labelled rows. From ``purity`` on, the
       template is rejected, and with it its rows that no rule fits; one without labels is at 1/2 and never is.

    Null url, or one without ``://``: host and path empty, judged like any other (host ''). Null ids and repeated rows are
    judged like any other and count each. Empty table: no rows. Very long urls are read whole; what lies beyond ``depth`` segments
    is one tail of wildcards and words. Hosts with a large part of all rows are summed before any shuffle; the join back of verdicts
    is by (host, template) against a written table, which adaptive execution can split.
    Returns page_id, host, path, rule, verdict, template, block_share.
    """
    url = pages["url"]
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"), path_form(F.col("path")).alias("form"))
    segs = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/+")
    rows = rows.withColumn("segs", F.transform(segs, segment_shape))
    names = [f"s{i}" for i in range(depth)]
    rows = rows.select("page_id", "host", "path", "rule", "ruled", "form", *[F.coalesce(F.get("segs", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)], F.array_join(F.slice("segs", depth + 1, 1 << 30), "/").alias("tail"))
    # distinct shapes of each host with their counts: what the tree is grown from
    keys = ["host", *names, "tail"]
    counted = rows.groupBy(*keys, "form").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    tree = materialize(counted, "url-shapes")
    parent = ["host"]
    for i, name in enumerate(names):
        kids = tree.groupBy(*parent, name).agg(F.sum("n").alias("kn")).groupBy(*parent).agg(F.count("*").alias("names"), F.sum("kn").alias("kn"))
        wide = kids.select(*parent, ((F.col("names") > distinct) & (F.col("names") > varied * F.col("kn"))).alias("wide"))
        old, tree = tree, materialize(tree.join(wide, parent).withColumn(f"t{i}", F.when(F.col("wide"), "*").otherwise(F.col(name))).drop("wide"), f"url-wide{i}")
        merged = tree.join(_alike(tree, parent, f"t{i}", z), [*parent, f"t{i}"])
        older, tree = tree, materialize(merged.withColumn(f"m{i}", F.when(F.col("alike"), "{*}").otherwise(F.col(f"t{i}"))).drop("alike", f"t{i}"), f"url-tree{i}")
        discard(old, older)
        parent.append(f"m{i}")
    template = [*parent, "tail"]
    share = tree.groupBy(*template).agg(((F.sum("blocked") + weight / 2) / (F.sum("labelled") + weight)).alias("block_share"))
    shown = F.concat(F.lit("/"), F.concat_ws("/", F.array_compact(F.array(*[F.when(F.col(c) != "", F.col(c)) for c in template[1:]]))))
    verdicts = tree.select(*keys, *parent[1:]).distinct().join(share, template).select(*keys, shown.alias("template"), "block_share")
    verdicts = materialize(verdicts, "url-verdicts")
    discard(tree)
    by_method = F.when(F.col("block_share") >= purity, "block").otherwise("allow")
    return rows.join(verdicts, keys, "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", "block_share")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
