"""URL verdicts from host and path rules, then from a tree of path templates per host.

DataFrame operations only. Segments that look variable (numbers, hashes, dates) become
typed wildcards before anything is counted, so a host of any size is as many rows as it
has path shapes. The tree is then walked down level by level: children of a node that
are many, rare and too seldom labelled to compare become one wildcard, and so do branches
whose labelled rates don't differ significantly from those of their siblings. A template whose smoothed share of bad
labels reaches the threshold is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (host, path, verdict): a rule fits its host, all subdomains, and paths that begin with its path.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Below this level the tree goes on only under nodes with labels; without any, the rest of a path is one "**", which changes no verdict.
MAX_DEPTH = 8
#: A node with more children than this keeps, of those with fewer labels than MIN_LABELS, only those that hold a share of its pages.
MAX_CHILDREN = 20
MIN_CHILD_SHARE = 0.02
#: Branches are compared when both sides have so many labels, and merged below this score.
MIN_LABELS = 5
SAME_BELOW_Z = 1.96
#: Smoothing: so many imagined labels with that share of bad ones.
PRIOR_LABELS = 5.0
PRIOR_BAD = 0.2
REJECT_AT = 0.7

#: Shapes of variable segments, the first that fits; an extension or a trailing slash stays.
SHAPES = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "{date}"),
    (r"[0-9]+", "{n}"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "{uuid}"),
    (r"(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,}", "{hex}"),
    (r"(?=[^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9])[\w-]{12,}", "{id}"),
)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(after, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. rules are tens, not millions."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path's segments, variable ones as typed wildcards."""

    def one(segment: Column) -> Column:
        out = segment
        for pattern, name in reversed(SHAPES):
            whole = rf"^(?:{pattern})(\.[A-Za-z0-9]{{1,5}})?$"
            out = F.when(segment.rlike(whole), F.concat(F.lit(name), F.regexp_extract(segment, whole, 1))).otherwise(out)
        return out

    parts = F.split(path, "/")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)


def _level(rows: DataFrame, d: int) -> DataFrame:
    """The templates of all paths after their segment number d has been named."""
    at = rows.where(F.size("segments") > d).withColumn("seg", F.col("segments")[d])
    sums = lambda: [F.sum(c).alias(c) for c in ("n", "labels", "bad")]
    children = at.groupBy("host", "template", "seg").agg(*sums())
    nodes = children.groupBy("host", "template").agg(F.count("*").alias("branches"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labels", "bad")))
    met = children.join(nodes, ["host", "template"])
    rest, rest_bad = F.col("all_labels") - F.col("labels"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.col("all_labels")
    spread = F.sqrt(share * (1 - share) * (1 / F.col("labels") + 1 / rest))
    gap = F.abs(F.col("bad") / F.col("labels") - rest_bad / rest)
    compared = (F.col("labels") >= MIN_LABELS) & (rest >= MIN_LABELS)
    alike = F.when(compared, gap <= SAME_BELOW_Z * spread).otherwise(False)
    # Fewer bad labels than MIN_LABELS never reach REJECT_AT on their own; children with more are merged by their rates alone.
    rare = (F.col("branches") > MAX_CHILDREN) & (F.col("n") < MIN_CHILD_SHARE * F.col("all_n")) & (F.col("labels") < MIN_LABELS)
    typed = F.col("seg").startswith("{") | (F.col("seg") == "**") | (F.col("seg") == "")
    named = met.select("host", "template", "seg", F.when(~typed & (rare | alike), F.lit("*")).otherwise(F.col("seg")).alias("name"))
    moved = at.join(named, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), "name")).select(*rows.columns)
    return moved.unionByName(rows.where(F.size("segments") <= d))


def _ended(deep: DataFrame, d: int) -> DataFrame:
    """deep with ended: whether the path's template is whole, as its node has no labels or no other path."""
    nodes = deep.groupBy("host", "template").agg(F.sum("labels").alias("node_labels"), F.count("*").alias("shapes"))
    rest = F.array_join(F.slice("segments", F.lit(d + 1), F.size("segments")), "/")
    name = F.when(F.col("node_labels") == 0, F.lit("/**")).when(F.col("shapes") == 1, F.concat(F.lit("/"), rest))
    named = deep.join(nodes, ["host", "template"]).withColumn("name", name)
    return named.select(*(c for c in deep.columns if c != "template"), F.concat("template", F.coalesce("name", F.lit(""))).alias("template"), F.col("name").isNotNull().alias("ended"))


def template_tree(pages: DataFrame) -> DataFrame:
    """host, segments, template, purity, n_labels of every path shape of (host, segments, bad).

    bad is 1, 0 or null (no label).
    """
    rows = stored(pages.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")).withColumn("template", F.lit("")), "path-shapes")
    depth = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for d in range(min(depth, MAX_DEPTH)):
        rows = stored(_level(rows, d), "templates")
    deep, d = rows.where(F.size("segments") > MAX_DEPTH), MAX_DEPTH
    rows = rows.where(F.size("segments") <= MAX_DEPTH)
    while d < depth and not deep.isEmpty():
        ended = stored(_ended(deep, d), "deep-nodes")
        level = stored(_level(ended.where("not ended").drop("ended"), d), "templates")
        rows = rows.unionByName(ended.where("ended").drop("ended")).unionByName(level.where(F.size("segments") <= d + 1))
        deep, d = level.where(F.size("segments") > d + 1), d + 1
    total = rows.groupBy("host", "template").agg(F.sum("labels").alias("n_labels"), F.sum("bad").alias("n_bad"))
    purity = (F.col("n_bad") + PRIOR_LABELS * PRIOR_BAD) / (F.col("n_labels") + PRIOR_LABELS)
    return rows.select("host", "segments", "template").join(total.select("host", "template", "n_labels", purity.alias("purity")), ["host", "template"])


def rules_left_out(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """What the tree says of each rule's pages when it learns from the other rules alone.

    (rule, verdict, learnt, n): pages that the rule decides, by the rule's verdict and the learnt one. Pages that
    another rule fits once this one is left out are labelled by that one, and aren't counted.
    """
    out = None
    for h, p, v in rules:
        rest = [r for r in rules if r[:2] != (h, p)]
        all_rules = judge_urls(pages, rules=rules).where(F.col("rule") == h + p).select("page_id").distinct()
        learnt = judge_urls(pages, rules=rest).where("rule is null").join(all_rules, "page_id", "left_semi")
        part = learnt.groupBy(F.col("verdict").alias("learnt")).agg(F.count("*").alias("n"), F.max("n_labels").alias("most_labels")).select(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), "learnt", "n", "most_labels")
        out = part if out is None else out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template, purity, n_labels.

    labels (page_id, bad 0/1; repeated ids count as bad if any is) adds to the rules' own
    verdicts, which label the pages that they fit. A null url, or one without ://, has empty
    host and path, which no rule fits; it is judged by the template of empty paths. Repeated
    rows and null ids are each returned and counted. Without labels every template is allowed.
    """
    url = F.col("url").cast("string")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("*", rule.alias("rule"), fixed.alias("fixed"), shape_of(F.col("path")).alias("segments"))
    ruled = F.when(F.col("fixed") == "block", 1).when(F.col("fixed") == "allow", 0)
    if labels is not None:
        given = labels.where("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("l_id")).agg(F.max(F.col("bad").cast("int")).alias("given"))
        own = own.join(given, own.page_id == given.l_id, "left").drop("l_id").withColumn("bad", F.coalesce(ruled, "given")).drop("given")
    else:
        own = own.withColumn("bad", ruled)
    own = stored(own, "urls")
    tree = template_tree(own)
    judged = F.when(F.col("purity") >= REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))
    met = own.join(tree, ["host", "segments"])
    return met.select("page_id", "host", "path", "rule", F.coalesce("fixed", judged).alias("verdict"), "template", "purity", "n_labels")
