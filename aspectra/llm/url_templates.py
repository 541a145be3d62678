"""URL filter: rules first, then a tree of path templates per host.

The path of a page without a rule is generalised to a template: segments that
look like numbers or ids become ``*``, and so do segments at a place of the tree
that has nearly as many different children as pages.  Sibling branches whose
labelled shares do not differ significantly are merged.  A template without
labels takes the share of its labelled siblings, else of its nearest labelled
ancestor.  A template is rejected if its smoothed share of bad labels is high.
Labels are the pages that a rule decides, or any column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import broadcast_checked
from aspectra.session import cut_lineage

# FIXED VALUES: (verdict, host, path) of the base rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

MANY_CHILDREN, CHILD_SHARE = 50, 0.3     # a place with so many children, and so many per page, is variable
SIMILAR_Z = 2.0                          # siblings within so many deviations of their common share are merged
SMOOTHING, REJECT = 4.0, 0.8             # weight of the overall share, and the share from which a template is rejected

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both '' without '://'."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def longest_rule(host: str, path: str, rules) -> Column:
    """The rule (as host + path) that fits and is longest, else null."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        found = F.when(fits, F.lit(h + p)).otherwise(found)
    return found


def _lexical(s: Column) -> Column:
    """Numbers, and longer names with digits, become '*'; an extension stays."""
    name, ext = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    variable = name.rlike(r"^\d+$") | (name.rlike(r"\d") & (F.length(name) >= 6)) | name.rlike(r"^[0-9a-fA-F-]{16,}$")
    return F.when(variable, F.concat(F.lit("*"), ext)).otherwise(s)


def templates(pages: DataFrame) -> DataFrame:
    """Adds ``template`` (an array of segments) to rows with host and path."""
    df = pages.withColumn("template", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _lexical))
    # a place with MANY_CHILDREN has as many templates of its host below its level
    size = df.select("host", "template").distinct().groupBy("host", F.size("template").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    levels = (size.where("size > 0").select("host", "n", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("level"))
              .groupBy("host", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= MANY_CHILDREN))
    deepest = levels.agg(F.max("level")).first()[0]
    for level in range(0 if deepest is None else deepest + 1):
        # children of each place of the tree; counted before joining, so a hot host is a few rows
        place = F.concat_ws("/", F.slice("template", 1, level)) if level else F.lit("")
        at = df.where(F.size("template") > level).select("host", place.alias("place"), F.get("template", F.lit(level)).alias("child"))
        count = (at.groupBy("host", "place", "child").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "place")
                 .agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n"))
                 .where((F.col("children") >= MANY_CHILDREN) & (F.col("children") >= CHILD_SHARE * F.col("n")))
                 .select("host", "place", F.lit(True).alias("variable")))
        count = cut_lineage(count)
        if count.isEmpty():
            continue
        df = (df.withColumn("place", place).join(count, ["host", "place"], "left")
              .withColumn("template", F.when(F.col("variable") & (F.size("template") > level), F.transform(
                  "template", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s))).otherwise(F.col("template")))
              .drop("place", "variable"))
    return df


def _with_parent(df: DataFrame) -> DataFrame:
    """Adds ``parent``: the template with its last literal segment replaced by a mark."""
    last = F.expr("coalesce(array_max(transform(template, (s, i) -> if(startswith(s, '*'), -1, i))), -1)")
    return (df.withColumn("last", last)
            .withColumn("parent", F.concat_ws("/", F.expr("transform(template, (s, i) -> if(i = last, '<>', s))"))))


def tree(labelled: DataFrame, z: float = SIMILAR_Z, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, template, n, n_bad, purity): templates with labels.  Siblings are the
    templates of a host that agree except in their last literal segment; the
    counts of siblings near their common share are pooled."""
    counts = (labelled.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad")))
    counts = cut_lineage(_with_parent(counts))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("n_bad").alias("all_bad"))
    common = counts.groupBy("host", "parent").agg((F.sum("n_bad") / F.sum("n")).alias("p"))
    df = counts.join(common, ["host", "parent"])
    sd = F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p")))
    df = df.withColumn("alike", F.abs(F.col("n_bad") - F.col("n") * F.col("p")) <= z * sd)
    pooled = df.where("alike").groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("n_bad").alias("pb"))
    df = df.join(pooled, ["host", "parent"], "left")
    n, bad = F.when(F.col("alike"), F.col("pn")).otherwise(F.col("n")), F.when(F.col("alike"), F.col("pb")).otherwise(F.col("n_bad"))
    df = df.join(F.broadcast(total))                                       # one row
    share = F.col("all_bad") / F.col("all_n")
    return df.select("host", "template", n.alias("n"), bad.alias("n_bad"), ((bad + smoothing * share) / (n + smoothing)).alias("purity"))


def inherited(wanted: DataFrame, labelled: DataFrame, z: float = SIMILAR_Z, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, template, purity) of templates without labels: the smoothed share of
    their labelled siblings that are alike, else of all labelled templates below the
    longest common prefix, at last of the host.  Hosts without labels are left out."""
    counts = cut_lineage(labelled.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad")))
    total = counts.agg((F.sum("n_bad") / F.sum("n")).alias("share"))
    # alike siblings have one pooled count, which is the parent's largest
    siblings = _with_parent(tree(labelled, z, smoothing)).where("last >= 0").groupBy("host", "parent").agg(
        F.max(F.struct("n", "purity")).alias("m")).select("host", F.concat(F.lit("<>/"), "parent").alias("key"), F.col("m.purity").alias("purity"))
    prefix = lambda i: F.concat_ws("/", F.lit("^"), F.slice("template", 1, i))
    keys = F.transform(F.sequence(F.lit(0), F.size("template")), prefix)
    above = (counts.select("host", "n", "n_bad", F.explode(keys).alias("key")).groupBy("host", "key")
             .agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")).join(F.broadcast(total))
             .select("host", "key", ((F.col("n_bad") + smoothing * F.col("share")) / (F.col("n") + smoothing)).alias("purity")))
    near = _with_parent(wanted).select(
        "host", "template", F.explode(F.concat(F.transform(keys, lambda k, i: F.struct(i.alias("rank"), k.alias("key"))), F.array(
            F.struct((F.size("template") + 1).alias("rank"), F.concat(F.lit("<>/"), "parent").alias("key"))))).alias("k"))
    return (near.select("host", "template", "k.rank", "k.key").join(broadcast_checked(above.union(siblings)), ["host", "key"])
            .groupBy("host", "template").agg(F.max(F.struct("rank", "purity")).alias("m")).select("host", "template", F.col("m.purity").alias("purity")))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label_col: str | None = None,
                reject: float = REJECT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template,
    purity.

    The longest fitting rule decides.  Other pages are blocked if their
    template's smoothed share of bad labels, its own or inherited, reaches
    ``reject`` and allowed else; a host without labels has no purity and is allowed.  ``label_col`` (1
    bad, 0 good, null none) replaces the labels that the rules give.  A null URL
    or one without '://' has '' as host and path.  Repeated rows are judged
    alike; other columns are ignored; an empty table gives an empty result."""
    host, path = host_and_path("_url")
    label = [F.col(label_col).cast("long").alias("bad")] if label_col else []
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), *label).withColumn("host", host).withColumn("path", path).drop("_url")
    df = df.withColumn("rule", longest_rule("host", "path", rules))
    verdicts = F.create_map(*[F.lit(x) for v, h, p in rules for x in (h + p, v)])
    df = df.withColumn("by_rule", F.element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string"))
    if not label_col:
        df = df.withColumn("bad", F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "block").cast("long")))
    df = cut_lineage(templates(df))
    labelled = df.where("bad is not null").select("host", "template", "bad")
    found = cut_lineage(tree(labelled).select("host", "template", "purity"))
    wanted = df.where("by_rule is null").select("host", "template").distinct().join(found, ["host", "template"], "left_anti")
    found = found.union(inherited(wanted, labelled))
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return (df.join(found, ["host", "template"], "left")
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat_ws("/", "template").alias("template"),
                    F.round("purity", 6).alias("purity")))
