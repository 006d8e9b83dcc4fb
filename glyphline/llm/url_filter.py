"""URL filters by a tree of path templates for each host (DataFrame functions only).

Segments of a path that look like numbers or hashes become wildcards, and so do the children of a node that
has many different ones which hardly repeat.  Below a number's wildcard the tree branches by leading digit and by length.
URLs that a rule decides are the labelled ones.  Labelled siblings that are statistically alike pool
their labels: chi-square tests compare a branch's labels, and the forms of what lies below it (depth,
kind of the next segment, extension), with those of all labelled siblings.  Where nothing varies there is no test to fail.
Branches without labels pool with none.

A node with several children expects of a child the mean share of blocked labels over its labelled children, each
counted once, smoothed towards what was expected of the node itself (of a host: a half).  A branch's purity is its pooled share
of blocked labels smoothed towards what is expected of it, and that expectation where it has no labels.  So one branch's
many labels say little of its siblings, several like-minded branches say more.  Templates of high purity are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Templates of up to so many bytes are broadcast to the URLs; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or where it is null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. A rule ``host/path`` fits the host and all its subdomains if the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules.items(), key=lambda x: (len(x[0]), x[0])):  # a longer one is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments, variable looking ones as wildcards; behind a number's, its leading digit and its length."""

    def steps(s: Column) -> Column:
        number = F.regexp_extract(s, "^([0-9]+)", 1)
        parts = lambda first: F.array(first, F.concat(F.lit("~"), F.substring(number, 1, 1)), F.concat(F.lit("~len"), F.length(number).cast("string")))
        return (
            F.when(s.rlike("^[0-9]+$"), parts(F.lit("{n}")))
            .when(s.rlike(r"^[0-9]+\.[A-Za-z]+$"), parts(F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.([A-Za-z]+)$", 1))))
            .when(s.rlike("^[0-9a-fA-F-]{8,}$"), F.array(F.lit("{x}")))
            .otherwise(F.array(s))
        )

    return F.flatten(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), steps))


def _prefix(steps: str, length: Column) -> Column:
    """Names the first ``length`` steps; segments hold no slash."""
    return F.md5(F.array_join(F.slice(steps, 1, length), "/").cast("binary"))


def generalise(leaves: DataFrame, max_children: int, min_repeat: float) -> DataFrame:
    """leaves(host, segs, n, ...) with ``steps``: segs where ``*`` replaces the children of crowded nodes.

    A round counts the children of all nodes of all levels in one pass, and replaces those of the crowded node
    nearest the root of each path; the nodes below are counted anew, so a path takes a round for each of its crowded nodes.
    """
    out = leaves.withColumn("steps", F.col("segs"))
    while True:
        each = F.explode(F.transform("steps", lambda s, i: F.struct((i + 1).alias("level"), _prefix("steps", i).alias("node"), s.alias("step")))).alias("x")
        children = out.select("host", "n", each).groupBy("host", "x.level", "x.node", "x.step").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "level", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("urls"))
        crowded = nodes.where((F.col("kinds") > max_children) & (F.col("urls") < min_repeat * F.col("kinds"))).select("host", "level", "node")
        crowded = materialize(crowded, "url-crowded")
        if crowded.isEmpty():
            return out
        hit = out.select("host", "segs", each).select("host", "segs", "x.level", "x.node").join(crowded, ["host", "level", "node"])
        first = hit.groupBy("host", "segs").agg(F.min("level").alias("first"))
        starred = F.transform("steps", lambda s, i: F.when(i + 1 == F.col("first"), F.lit("*")).otherwise(s))
        out = out.join(first, ["host", "segs"], "left").withColumn("steps", F.when(F.col("first").isNull(), F.col("steps")).otherwise(starred)).drop("first")
        out = materialize(out, "url-tree")


def _critical(df: Column, z: float) -> Column:
    """What a chi-square of ``df`` degrees of freedom exceeds as rarely as a normal deviate exceeds z (Wilson and Hilferty)."""
    part = 2 / (9 * df)
    return df * F.pow(1 - part + z * F.sqrt(part), F.lit(3.0))


def purities(templates: DataFrame, smoothing: float, z_merge: float) -> DataFrame:
    """templates(host, steps, n, bad, labelled) -> host, leaf (name of the steps), purity."""
    t = templates.withColumn("leaf", _prefix("steps", F.size("steps"))).withColumn("ext", F.coalesce(F.try_element_at("steps", F.lit(-1)), F.lit("")).contains("."))
    t = t.withColumn("steps", F.concat("steps", F.array(F.lit("$"))))  # a URL that ends at a node is a branch of it

    def at(s: Column, i: Column) -> Column:
        after = F.get("steps", i + 1)
        kind = F.when(after.isNull(), F.lit("")).when(after.rlike(r"^[*{~$]"), F.substring(after, 1, 1)).otherwise(F.lit("w"))
        form = F.concat(F.least(F.size("steps") - i, F.lit(5)).cast("string"), kind, F.col("ext").cast("string"))
        return F.struct((i + 1).alias("level"), _prefix("steps", i).alias("parent"), _prefix("steps", i + 1).alias("node"), form.alias("form"))

    each = t.select("host", "leaf", "n", "bad", "labelled", F.explode(F.transform("steps", at)).alias("x")).select("host", "leaf", "n", "bad", "labelled", "x.*")
    family, one = ["host", "level", "parent"], ["host", "level", "parent", "node"]
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "labelled")]
    forms = materialize(each.groupBy(*one, "form").agg(*sums), "url-forms")
    nodes = forms.groupBy(*one).agg(*sums)
    known = F.col("labelled") > 0
    families = nodes.groupBy(*family).agg(
        F.count("*").alias("kids"), F.count(F.when(known, 1)).alias("told"), F.coalesce(F.sum(F.when(known, F.col("bad") / F.col("labelled"))), F.lit(0.0)).alias("shares"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"),
    )
    marked = nodes.where(known)
    of_marked = forms.select(*one, "form", F.col("n").alias("form_n")).join(marked.select(*one, "n"), one)
    pooled = of_marked.groupBy(*family, "form").agg(F.sum("form_n").alias("pool_n"))
    kinds = pooled.groupBy(*family).agg(F.count("*").alias("kinds"))
    spread = of_marked.join(pooled, [*family, "form"]).groupBy(*one).agg(F.sum(F.col("form_n") * F.col("form_n") / F.col("pool_n")).alias("squares"))
    c = marked.join(families, family).join(kinds, family).join(spread, one)
    share = F.col("all_bad") / F.col("all_labelled")
    by_label = F.when(share * (1 - share) > 0, F.pow(F.col("bad") - F.col("labelled") * share, F.lit(2.0)) / (F.col("labelled") * share * (1 - share))).otherwise(0.0)
    by_form = F.col("all_n") * F.col("squares") / F.col("n") - F.col("n")
    same = (by_label < _critical(F.lit(1.0), z_merge)) & ((F.col("kinds") == 1) | (by_form < _critical(F.greatest(F.col("kinds") - 1, F.lit(1)).cast("double"), z_merge)))
    c = materialize(c.select(*one, "bad", "labelled", same.alias("same")), "url-branches")
    merged = c.where("same").groupBy(*family).agg(F.sum("bad").alias("m_bad"), F.sum("labelled").alias("m_labelled"))
    c = c.join(merged, family, "left").select(*one, *(F.when(F.col("same"), F.col(f"m_{x}")).otherwise(F.col(x)).cast("double").alias(x) for x in ("bad", "labelled")))
    held = nodes.select(*one).join(families.select(*family, "kids", "told", "shares"), family).join(c, one, "left")
    way = each.select("host", "leaf", *one[1:]).join(held, one).groupBy("host", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "kids", "told", "shares", "bad", "labelled"))).alias("way"))  # as long as the path

    def down(p: Column, x: Column) -> Column:
        expected = F.when(x["kids"] > 1, (x["shares"] + smoothing * p["expected"]) / (x["told"] + smoothing)).otherwise(p["expected"])
        return F.struct(expected.alias("expected"), F.when(x["labelled"] > 0, (x["bad"] + smoothing * expected) / (x["labelled"] + smoothing)).otherwise(expected).alias("purity"))

    start = F.struct(F.lit(0.5).alias("expected"), F.lit(0.5).alias("purity"))
    return way.select("host", "leaf", F.round(F.aggregate("way", start, down, lambda p: p["purity"]), 9).alias("purity"))


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", max_children: int = 20, min_repeat: float = 5.0, smoothing: float = 2.0, z_merge: float = 1.96, reject: float = 0.7, learn: Column | None = None) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, template, purity, learned.

    ``learned`` is block where the template's purity reaches ``reject``, else allow: on a host without labels nothing is
    blocked. verdict is the rule's, else ``learned``. Rows that don't fulfil ``learn`` (a condition on ``pages``; all do without one) lend
    the tree no label, so that it can be held against their rules. Null URLs and those without ``://`` have an empty host and path,
    which are a host and a path like others. Repeated rows are judged each. Other columns, whatever their names, are ignored.
    An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("learn"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("said", said).withColumn("segs", segments(F.col("path")))
    # the tree is built from distinct shapes: counted before any shuffle, a busy host is a few rows
    label = F.when(F.col("learn"), F.col("said"))
    leaves = urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count(F.when(label == "block", 1)).alias("bad"), F.count(label).alias("labelled"))
    leaves = generalise(materialize(leaves, "url-leaves"), max_children, min_repeat)
    templates = leaves.groupBy("host", "steps").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "labelled")))
    known = leaves.withColumn("leaf", _prefix("steps", F.size("steps"))).join(purities(templates, smoothing, z_merge), ["host", "leaf"])
    shown = F.concat(F.lit("/"), F.regexp_replace(F.array_join("steps", "/"), "/~", "~"))
    known = materialize(known.select("host", "segs", shown.alias("template"), "purity"), "url-templates")
    held = known.agg(F.sum(F.octet_length("host") + F.octet_length("template") + F.octet_length(F.array_join("segs", "/")) + 100)).first()[0] or 0
    if held <= BROADCAST_BYTES:  # else a hot host is split by the adaptive join
        known = F.broadcast(known)
    out = urls.join(known, ["host", "segs"]).withColumn("learned", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", "learned").alias("verdict"), "template", "purity", "learned")
