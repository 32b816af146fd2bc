"""URL filter by a path-template tree.

Pages are counted by host and path first, and the tree is grown on those counts. Below each host, paths are a tree of
segments (compared without case). Level by level, a segment that fewer than ``SUPPORT`` pages of its node have becomes a
wildcard. Of the others, sister branches of one shape (kinds of characters, length, pages for each path below, share of
paths that end there) merge if their bad rates can't be told apart. A path leaves the loop when it ends, when its node has
too few pages to tell any segment apart, or when its node holds no other path: a deep path costs no further round.

A rate is ``bad + SMOOTH * parent's rate`` over ``labelled + UNLABELLED * others + SMOOTH``: it is smoothed towards the
parent, and so towards the sister branches, and a page without a label speaks a little for its template. The rate of a
page's last node is its template's purity. The purity from which a template is rejected is the largest that finds about as
many hidden labels as any at which ``PRECISION`` of what is rejected is rightly so: beside the tree of all labels, and in the same rounds, one is grown without a third of the labelled paths,
drawn by hash, which are only led through it; a page that has no label and would be rejected counts against the limit
like a good one. Explicit rules come first and serve as labels here.

Only counts are compared, never pages: each level is an aggregation by (host, way, segment), reduced before the shuffle;
nodes and branches with enough pages are few and broadcast after a count, so a host with a third of all paths is
spread. Branches are merged in the order of at most ``RATES`` steps of their rates, so a node may have any number of
them. Each level is written, so lineage stays short. No Python runs on executors.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty path is the template of its
host alone. Rows that repeat a page each get a row, null ids too. Very long and very deep paths are judged whole. Null
labels are no labels. With none at all, none that can be hidden, or no limit of that precision, ``PURITY`` is the limit. An empty table gives an empty
result. Extra columns play no part in ``judged`` and pass ``keep_allowed`` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import broadcast_if_small, materialize

# A segment stays if at least so many pages have it.
SUPPORT = 5
# What a page without a label counts as, and the weight of the parent's rate.
UNLABELLED = 0.25
SMOOTH = 2.0
# Rates are told apart by steps of 1 / RATES and intervals of WIDTH standard errors; merged branches list up to LISTED segments.
RATES = 1000
WIDTH = 2.0
LISTED = 50
# Limits of purity to choose from, the precision that one must have, and the limit where none has it.
LIMITS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
PRECISION = 0.97
# What a larger limit may find less than the best, so that fewer pages without a label are rejected.
SLACK = 0.02
PURITY = 0.8
HIDDEN = 3  # one labelled path of so many is hidden from the second tree
HOT_PAGES = 50_000  # pages of one path from which it is joined on its own
# Two trees are grown at once: with all labels, and without the hidden ones.
ALL, BLIND = 0, 1
NODE = ["tree", "host", "way"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty where there is no ``://``."""
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, PARTS, 1), UPPER, LOWER), F.regexp_extract(known, PARTS, 2)


def _fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, start = rule.partition("/")
    return ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)


def longest_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule (``host/path``) that fits, or null. Rules are a short list, compiled to one expression."""
    fit = [F.when(_fits(r, host, path), F.lit(r)) for r in sorted(rules, key=lambda r: (-len(r), r))]
    return F.coalesce(*fit, F.lit(None).cast("string"))


def _smoothed(bad: Column, labelled: Column, n: Column, prior: Column) -> tuple[Column, Column]:
    """The rate, and the weight of what it rests on."""
    weight = labelled + (n - labelled) * UNLABELLED + SMOOTH
    return (bad + prior * SMOOTH) / weight, weight


def _totals() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]


def path_counts(pages: DataFrame) -> DataFrame:
    """``host``, ``path``, ``n``, ``labelled``, ``bad`` of a table with ``host``, ``path`` and ``label`` (1 bad, 0 good, null)."""
    counted = pages.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad"))
    return materialize(counted)


def is_hidden() -> Column:
    return (F.pmod(F.xxhash64("host", "path"), F.lit(HIDDEN)) == 0) & (F.col("labelled") > 0)


def both_trees(counts: DataFrame) -> DataFrame:
    """The counts of both trees; hidden paths count as nothing in the second."""
    seen = F.when(is_hidden(), F.lit(0))
    blind = counts.withColumns({c: seen.otherwise(F.col(c)).cast("long") for c in ("n", "labelled", "bad")})
    return counts.withColumn("tree", F.lit(ALL)).unionByName(blind.withColumn("tree", F.lit(BLIND)))


def _shape(counts: DataFrame) -> Column:
    """What branches must have in common to be merged: shape of the name, pages for each path below, paths that end here."""
    kinds = [F.col("segment").rlike(p).cast("string") for p in ("[0-9]", r"\pL", r"[^0-9\pL]")]
    bucket = lambda x: F.floor(F.log2(x + 1)).cast("string")
    return F.concat_ws(",", *kinds, bucket(F.char_length("segment")), bucket(F.col("n") / F.col("paths")), F.round(2 * F.col("ends") / F.col("paths")).cast("string"))


def _branches(counts: DataFrame) -> DataFrame:
    """Node, ``segment`` and ``child`` of the segments that keep a branch, alone or merged with sisters.

    Sisters without any label stay apart: nothing can be learnt from merging them.
    """
    kept = counts.filter(F.col("n") >= SUPPORT)
    rate, weight = _smoothed(F.col("bad"), F.col("labelled"), F.col("n"), F.col("rate"))
    error = WIDTH * F.sqrt(rate * (1 - rate) / weight)
    rated = kept.select(*NODE, "segment", _shape(kept).alias("shape"), F.floor(rate * RATES).alias("step"),
                        (rate - error).alias("low"), (rate + error).alias("high"), "labelled")
    sister = [*NODE, "shape"]
    steps = rated.groupBy(*sister, "step").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy(*sister).orderBy("step")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = steps.withColumn("new", F.when(before.isNull() | (F.col("low") > before), 1).otherwise(0))
    numbered = parted.select(*sister, "step", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("branch"))
    grouped = rated.select(*sister, "segment", "step", "labelled").join(numbered, [*sister, "step"]).drop("step")
    group = [*sister, "branch"]
    sizes = grouped.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.min("segment").alias("least"), F.sum("labelled").alias("labels"))
    merged = sizes.filter("size > 1 and labels > 0")
    listed = grouped.join(merged.filter(F.col("size") <= LISTED).select(*group), group).groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list("segment")), "|").alias("child"))
    long = merged.filter(F.col("size") > LISTED).select(*group, F.concat("least", F.lit("|+"), F.col("size") - 1).alias("child"))
    names = listed.unionByName(long)
    return grouped.join(names, group, "left").select(*NODE, "segment", F.coalesce("child", "segment").alias("child"))


def grown(counts: DataFrame) -> DataFrame:
    """``tree``, ``host``, ``path``, ``way`` and ``purity`` of every path of each tree's counts."""
    totals = {r["tree"]: r["rate"] for r in counts.groupBy("tree").agg(*_totals()).select(
        "tree", _smoothed(F.col("bad"), F.col("labelled"), F.col("n"), F.lit(0.0))[0].alias("rate")).collect()}
    overall = F.when(F.col("tree") == BLIND, F.lit(totals.get(BLIND, 0.0))).otherwise(F.lit(totals.get(ALL, 0.0)))
    hosts = counts.groupBy("tree", "host").agg(*_totals()).select(
        "tree", "host", _smoothed(F.col("bad"), F.col("labelled"), F.col("n"), overall)[0].alias("rate"))
    path = F.regexp_replace("path", "^/", "")
    rest = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))
    alive = materialize(counts.withColumns({"rest": rest, "way": F.lit("")}).join(broadcast_if_small(hosts), ["tree", "host"]))
    result = ["tree", "host", "path", "way", F.col("rate").alias("purity")]
    done = []
    while not alive.isEmpty():
        done.append(alive.filter(F.size("rest") == 0).select(*result))
        deep = alive.filter(F.size("rest") > 0)
        nodes = deep.groupBy(*NODE).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_paths"))
        busy = broadcast_if_small(materialize(nodes.filter(f"_n >= {SUPPORT} and _paths > 1").select(*NODE, F.lit(True).alias("_busy"))))
        told = deep.join(busy, NODE, "left")
        stars = F.concat("way", F.lit("/"), F.array_join(F.transform("rest", lambda _: F.lit("*")), "/"))
        whole = F.concat("way", F.lit("/"), F.array_join("rest", "/"))
        ended = F.when(F.col("n") >= SUPPORT, whole).otherwise(stars)
        done.append(told.filter("_busy is null").select("tree", "host", "path", ended.alias("way"), F.col("rate").alias("purity")))
        onward = told.filter("_busy").drop("_busy").withColumn("segment", F.lower(F.get("rest", F.lit(0))))
        below = materialize(onward.groupBy(*NODE, "segment").agg(
            *_totals(), F.count(F.lit(1)).alias("paths"), F.count_if(F.size("rest") == 1).alias("ends"), F.max("rate").alias("rate")))
        named = _branches(below)
        children = below.join(named, [*NODE, "segment"], "left").withColumn("child", F.coalesce("child", F.lit("*")))
        rates = children.groupBy(*NODE, "child").agg(*_totals(), F.max("rate").alias("rate")).select(
            *NODE, "child", _smoothed(F.col("bad"), F.col("labelled"), F.col("n"), F.col("rate"))[0].alias("_rate"))
        kept = named.join(rates, [*NODE, "child"]).select(*NODE, "segment", "child", "_rate")
        wild = rates.filter("child = '*'").select(*NODE, F.lit(None).cast("string").alias("segment"), "child", "_rate")
        moves = broadcast_if_small(materialize(kept.unionByName(wild)))
        own = moves.filter("segment is not null").withColumnRenamed("_rate", "_own")
        rare = moves.filter("segment is null").select(*NODE, F.col("_rate").alias("_wild"))
        moved = onward.join(own, [*NODE, "segment"], "left").join(rare, NODE, "left")
        alive = materialize(moved.select(
            "tree", "host", "path", "n", "labelled", "bad", F.slice("rest", 2, F.size("rest")).alias("rest"),
            F.concat("way", F.lit("/"), F.coalesce("child", F.lit("*"))).alias("way"), F.coalesce("_own", "_wild").alias("rate")))
    return materialize(reduce(DataFrame.unionByName, done, alive.select(*result)))


def _per_page(pages: DataFrame, ways: DataFrame, counts: DataFrame) -> DataFrame:
    """Every page with its path's row. Paths of very many pages are few, so they are joined apart, by broadcast."""
    hot = counts.filter(F.col("n") > HOT_PAGES).select("host", "path")
    if hot.isEmpty():
        return pages.join(ways, ["host", "path"])
    hot = broadcast_if_small(materialize(hot))
    common = pages.join(hot, ["host", "path"], "left_semi").join(F.broadcast(ways.join(hot, ["host", "path"], "left_semi")), ["host", "path"])
    return common.unionByName(pages.join(hot, ["host", "path"], "left_anti").join(ways, ["host", "path"]))


def templates(pages: DataFrame) -> DataFrame:
    """Add ``way``, the template of each page, and its ``purity`` to a table with ``host``, ``path`` and ``label`` (1 bad, 0 good, null)."""
    counts = path_counts(pages)
    return _per_page(pages, grown(counts.withColumn("tree", F.lit(ALL))).drop("tree"), counts)


def calibrated(counts: DataFrame, ways: DataFrame) -> tuple[float, list[tuple[float, float, float]]]:
    """The limit of purity chosen by hidden labels, and (limit, precision, recall) of each."""
    shown = F.when(is_hidden() | (F.col("labelled") == 0), F.lit(1))
    held = counts.filter(shown.isNotNull()).select("host", "path", "bad", (
        F.when(F.col("labelled") == 0, F.col("n")).otherwise(F.col("labelled") - F.col("bad"))).alias("good"))
    told = ways.filter(F.col("tree") == BLIND).join(held, ["host", "path"])
    over = [F.sum(F.when(F.col("purity") >= limit, F.col(x))).alias(f"{x}_{k}") for x in ("bad", "good") for k, limit in enumerate(LIMITS)]
    row = told.agg(F.sum("bad").alias("bad"), *over).first()
    if not row["bad"]:
        return PURITY, []
    figures = []
    for k, limit in enumerate(LIMITS):
        caught, wrong = row[f"bad_{k}"] or 0, row[f"good_{k}"] or 0
        figures.append((limit, caught / max(caught + wrong, 1), caught / row["bad"]))
    sound = {limit: recall for limit, precision, recall in figures if precision >= PRECISION and recall > 0}
    best = max(sound.values(), default=0.0)
    return max((limit for limit, recall in sound.items() if recall >= best - SLACK), default=PURITY), figures


def judged(pages: DataFrame, rules: dict[str, str], page_id: str = "page_id", url: str = "url", limit: float | None = None) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity``.

    ``rules`` map ``host/path`` to 'block' or 'allow'. The pages they fit are the labelled ones. Without ``limit`` it is
    chosen by hidden labels.
    """
    host, path = host_and_path(F.col(url))
    slim = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    blocked = [r for r, v in rules.items() if v == "block"]
    ruled = slim.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path")))
    labelled = ruled.withColumn("label", F.when(F.col("rule").isNotNull(), F.col("rule").isin(*blocked).cast("int") if blocked else F.lit(0)))
    counts = path_counts(labelled)
    ways = grown(both_trees(counts) if limit is None else counts.withColumn("tree", F.lit(ALL)))
    limit = calibrated(counts, ways)[0] if limit is None else limit
    out = _per_page(labelled, ways.filter(F.col("tree") == ALL).drop("tree"), counts)
    own = F.when(F.col("rule").isNull(), F.when(F.col("purity") >= limit, "block").otherwise("allow"))
    verdict = F.coalesce(own, F.when(F.col("label") == 1, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat("host", "way").alias("template"), "purity")


def keep_allowed(pages: DataFrame, rules: dict[str, str], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose id has no blocked url, with exactly their columns; null ids stay."""
    blocked = judged(pages, rules, page_id, url).filter("verdict = 'block'").select(F.col("page_id").alias("blocked_id")).distinct()
    row = pages.select(F.struct("*").alias("row"), F.col(page_id).alias("id"))
    return row.join(blocked, F.col("id") == F.col("blocked_id"), "left_anti").select("row.*")
