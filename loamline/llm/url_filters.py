"""URL filters by a path-template tree.

Rules given by hand judge the urls they fit and label them for the rest. Paths are
read segment by segment from the host down, as far as a node's labels can tell its
branches apart. At each node segments start as one branch; those whose labelled share
of blocked urls differs from that of the rest of their branch, by a two-sided test,
leave it for a branch of higher or of lower shares, which is tested again, until all
segments of a branch are alike. So segments that vary (numbers, ids, words without
labels) end in one wildcard, and similar ones share a branch. The leaves are
templates. A template is rejected if its share of blocked urls, smoothed towards
that of the same path over all hosts and that towards the share over everything,
reaches a threshold. All steps are DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import LOWER, UPPER, discard, staged

ANY = "*"
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments_of(path: Column) -> Column:
    """All segments but empty ones; a * in a url is written %2A, as * stands for the wildcard."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.replace(s, F.lit(ANY), F.lit("%2A")))


def _branches(child: DataFrame, z: float, least: float) -> DataFrame:
    """Children (tree, node, seg, b, n) that leave their node's wildcard, as (tree, node, seg, step)."""
    own = ["tree", "node", "branch"]
    rows = staged(child.withColumn("branch", F.lit("")), "branches")
    while True:
        total = rows.groupBy(*own).agg(F.sum("b").alias("pb"), F.sum("n").alias("pn"))
        both = rows.join(total, own)
        rest = F.col("pn") - F.col("n")
        p, q, all_ = F.col("b") / F.col("n"), (F.col("pb") - F.col("b")) / F.greatest(rest, F.lit(1)), F.col("pb") / F.col("pn")
        error = F.sqrt(all_ * (1 - all_) * (1 / F.col("n") + 1 / F.greatest(rest, F.lit(1))))
        # the normal approximation holds from an expected count of ``least`` on in each of the four cells
        enough = F.least(F.col("n"), rest) * F.least("pb", F.col("pn") - F.col("pb")) >= least * F.col("pn")
        side = F.when(enough & (p - q > z * error), "+").when(enough & (q - p > z * error), "-").otherwise("")
        moved = staged(both.select("tree", "node", "seg", "b", "n", F.concat("branch", side).alias("branch"), (side != "").alias("moved")), "branches")
        discard(rows)
        rows = moved.drop("moved")
        rows._staged_path = moved._staged_path
        if moved.filter("moved").isEmpty():
            break
    many = rows.filter("branch <> ''").groupBy(*own).agg(F.count("*").alias("k"))
    step = F.concat(F.lit("/"), F.when(F.col("k") == 1, F.col("seg")).otherwise(F.concat(F.lit(ANY), "branch")))
    out = staged(rows.join(many, own).select("tree", "node", "seg", step.alias("step")), "steps")
    discard(rows)
    return out


def grow_templates(urls: DataFrame, z: float, least: float) -> DataFrame:
    """urls (tree, segs, n_block, n_label) with their template; trees grow side by side, a segment a round.

    A node grows while it has labels of both kinds, enough to test a branch, and a path
    that goes on; its urls share one template else. Rounds end with the deepest
    such node.
    """
    columns = ["tree", "segs", "n_block", "n_label"]
    rows, finished, level = staged(urls.withColumn("node", F.lit("")), "trees"), [], 0
    while True:
        level += 1
        rows_here = rows.withColumn("seg", F.try_element_at("segs", F.lit(level)))
        child = rows_here.groupBy("tree", "node", "seg").agg(F.sum("n_block").alias("b"), F.sum("n_label").alias("n"))
        nodes = child.groupBy("tree", "node").agg(F.sum("b").alias("pb"), F.sum("n").alias("pn"), F.bool_or(F.col("seg").isNotNull()).alias("deeper"))
        growing = staged(nodes.filter(F.col("deeper") & (F.least("pb", F.col("pn") - F.col("pb")) >= 2 * least)).select("tree", "node"), "growing")
        if growing.isEmpty():
            finished.append(rows.select(*columns, F.concat("node", F.lit("/**")).alias("template")))
            break
        own = _branches(child.filter("seg is not null and n > 0").join(growing, ["tree", "node"], "left_semi"), z, least)
        marked = rows_here.join(growing.withColumn("grows", F.lit(True)), ["tree", "node"], "left").join(own, ["tree", "node", "seg"], "left")
        template = F.when(F.col("grows").isNull(), F.concat("node", F.lit("/**"))).when(F.col("seg").isNull(), F.when(F.col("node") == "", "/").otherwise(F.col("node")))
        step = F.concat("node", F.coalesce("step", F.lit("/" + ANY)))
        marked = staged(marked.select(*columns, F.when(template.isNull(), step).alias("node"), template.alias("template")), "trees")
        finished.append(marked.filter("template is not null").select(*columns, "template"))
        rows = marked.filter("template is null").select(*columns, "node")
    return reduce(DataFrame.unionByName, finished)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, z: float = 2.58, least: float = 5.0, smoothing: float = 8.0, threshold: float = 0.5) -> DataFrame:
    """Allow or block every url.

    ``pages`` needs page_id and url; other columns are ignored. ``rules`` is a short
    list of (host, path, verdict); a rule fits its host and all subdomains if the
    url's path starts with its path, and the longest wins. Returns page_id, host,
    path, rule, verdict, template and score (smoothed share of blocked urls), one
    row per input row; repeated rows get equal results. In a template a segment
    stands for itself, * for any other of its node, *+ or *- (and on) for a branch of
    several segments with a higher or lower share of blocked urls, and ** for all that
    follows. A score at the threshold blocks. Urls are read whole, however long.

    Null urls and urls without :// have an empty host and path,
    fit no rule and are judged like a host of their own. Without labels the score
    is 0 and urls are allowed; an empty table gives an empty result.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", segments_of(F.col("path")))
    blocked = (F.col("hit.verdict") == "block").cast("long")
    urls = staged(p.groupBy("host", "segs").agg(F.sum(F.coalesce(blocked, F.lit(0))).alias("n_block"), F.count("hit").alias("n_label")), "urls")

    overall = urls.agg((F.sum("n_block") / F.greatest(F.sum("n_label"), F.lit(1))).alias("rate")).first()["rate"] or 0.0
    # a tree for each host, and one over all hosts
    everywhere = urls.groupBy("segs").agg(F.sum("n_block").alias("n_block"), F.sum("n_label").alias("n_label")).select(F.lit(ANY).alias("tree"), "segs", "n_block", "n_label")
    trees = urls.select(F.concat(F.lit("="), "host").alias("tree"), "segs", "n_block", "n_label").unionByName(everywhere)
    grown = grow_templates(trees, z, least)
    sums = grown.groupBy("tree", "template").agg(F.sum("n_block").alias("b"), F.sum("n_label").alias("n"))
    # a template may hold most urls of all hosts: its rows meet its sum in parts
    sums = sums.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    grown = grown.select("tree", "template", "segs", F.pmod(F.xxhash64("segs"), F.lit(SALTS)).cast("int").alias("salt")).join(sums, ["tree", "template", "salt"])
    wide = grown.filter(F.col("tree") == ANY).select("segs", ((F.col("b") + smoothing * overall) / (F.col("n") + smoothing)).alias("wide_score"))
    scored = grown.filter(F.col("tree") != ANY).select(F.substring("tree", 2, 1 << 30).alias("host"), "segs", "template", "b", "n").join(wide, "segs")
    score = (F.col("b") + smoothing * F.col("wide_score")) / (F.col("n") + smoothing)
    scored = staged(scored.select("host", "segs", "template", score.alias("score")), "templates")
    out = p.join(scored, ["host", "segs"])
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", "score")
