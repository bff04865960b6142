"""Operator 5: url filter with a path-template tree, in DataFrame functions alone.

A url that a rule fits (host and its subdomains, path prefix, longest rule first) gets the rule's verdict.  These rule
verdicts are the labels from which the method judges all other urls:

1. Each path becomes a chain of segments, as deep as it is.  Segments that vary by their form (digits, long
   hexadecimal, long mixed) are generalised to wildcards at once.
2. The tree's nodes are counted per host, level and parent, all levels at once.  Where a node's children are many and
   few urls share one (more than ``MANY`` children, mean below ``FEW``), they vary too and merge into a wildcard; what
   lies below is counted again.
3. A template's labels are seen in ever narrower branches: the tree's root, each prefix of the template over all hosts,
   the whole template there, then within its top-level domain, its site and its host.  A branch is statistically
   similar to the one that it is part of if the likelihood-ratio test (``CRITICAL``) tells its share of blocked urls
   from that of the rest no further than chance does; it then merges into it and has its purity.  A branch without
   labels merges likewise.
4. A branch that stands alone has the purity of its own labels, smoothed with that of the branch around it as ``PRIOR``
   pseudo-counts; so a template's purity is that of the narrowest branch that stands alone.  Templates of purity
   ``BLOCK`` or more are rejected.

Counts are pre-aggregated; the tree holds templates, never urls, and the join back to the pages is an equi-join that
Spark may split where one host holds a large part of all rows.  Prefixes are known by their 64-bit hashes.

Defined results: null urls and urls without ``://`` have an empty host and path and the template of no segments; very
long urls are taken whole; ties of rule length go to the longer host, then the smaller text; repeated rows repeat;
null ids and ids of any size come back as they are; other columns, whatever their names, are ignored; without any
label nothing is blocked; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules given.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
MANY, FEW = 20, 8.0
PRIOR, BLOCK = 4.0, 0.5
#: Chi-squared with one degree of freedom at 5 %.
CRITICAL = 3.841
#: A registrable domain: a label before the top-level domain, or before a common second level of a country.
SITE = r"(?:^|\.)([^.]+\.(?:(?:co|com|org|net|ac|gov|edu)\.[a-z]{2}|[^.]+))$"


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "/", 1)).otherwise("")
    cut = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.coalesce(F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.instr(bare, "/")
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (slash > 0), bare.substr(slash, F.length(bare))).otherwise(""), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (text, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("rule_verdict")))
        for r in ordered
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,rule_verdict:string>"))


def _general(segment: Column) -> Column:
    """A segment that varies by its form becomes a wildcard that keeps its extension."""
    stem, ext = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2)
    varies = stem.rlike(r"^[0-9]+$") | stem.rlike(r"^[0-9a-fA-F-]{12,}$") | (stem.rlike("[0-9]") & (F.length(stem) > 16)) | (F.length(stem) > 48)
    return F.when(varies, F.concat(F.lit("*"), ext)).otherwise(segment)


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with site, tld and levels: the generalised segments."""
    segments = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    site = F.regexp_extract("host", SITE, 1)
    return urls.withColumns({"site": F.when(site == "", F.col("host")).otherwise(site), "tld": F.substring_index("host", ".", -1), "levels": F.transform(segments, _general)})


def _chain(steps: Column) -> Column:
    """The hash of the steps before each step, from none on."""
    return F.aggregate(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.xxhash64(F.element_at(a, -1), x)))


def merged(tree: DataFrame) -> DataFrame:
    """``tree`` (host, levels, n, ...) with template: a host's nodes with many rare children are wildcards.

    All nodes of all depths are counted at once.  A node without a wide one above it is settled by that; only the rows below wide
    nodes, whose children now are one, are counted again, and only below.  So there is a pass more for each wide node
    within a wide node, however deep the paths are.
    """
    rows = tree.withColumns({"row": F.monotonically_increasing_id(), "steps": F.col("levels"), "from": F.lit(0)})
    active, done = materialize(rows, "paths"), []
    names = [c for c in active.columns if c not in ("steps", "from")]
    while True:
        zipped = F.arrays_zip(_chain(F.col("steps")).alias("parent"), F.col("steps").alias("child"))
        spread = active.where(F.size("steps") > F.col("from")).select("row", "host", "n", "from", F.posexplode(zipped).alias("at", "x")).where(F.col("at") >= F.col("from"))
        spread = materialize(spread.select("row", "host", "n", "at", "x.parent", "x.child"), "nodes")
        nodes = spread.groupBy("host", "at", "parent", "child").agg(F.sum("n").alias("n"))
        wide = nodes.groupBy("host", "at", "parent").agg(F.count("*").alias("children"), F.sum("n").alias("total"), F.count_if(~F.col("child").startswith("*")).alias("plain"))
        wide = wide.where((F.col("children") > MANY) & (F.col("total") < FEW * F.col("children")) & (F.col("plain") > 0)).select("host", "at", "parent")
        first = materialize(spread.join(wide, ["host", "at", "parent"]).groupBy("row").agg(F.min("at").alias("at")), "wide")
        if not first.limit(1).collect():
            break
        done.append(active.join(first, "row", "left_anti"))
        step = lambda s, i: F.when((i == F.col("at")) & ~s.startswith("*"), F.lit("*")).otherwise(s)
        active = materialize(active.join(first, "row").select(*names, F.transform("steps", step).alias("steps"), (F.col("at") + 1).alias("from")), "paths")
    for part in done:
        active = active.unionByName(part)
    template = F.when(F.size("steps") > 0, F.concat(F.lit("/"), F.array_join("steps", "/"))).otherwise("")
    return active.withColumn("template", template).drop("row", "steps", "from")


def _information(b: Column, n: Column) -> Column:
    """Log-likelihood of b blocked among n urls at their own share."""
    term = lambda k: F.when(k > 0, k * F.ln(k / n)).otherwise(0.0)
    return term(b) + term(n - b)


def purity(base: Column, chain: Column) -> Column:
    """Purity at the end of ``chain``, an array of (n, b) from the root to the narrowest branch; ``base`` is the root's."""

    def narrower(wide: Column, x: Column) -> Column:
        n, b = x["n"], x["b"]
        rest_n, rest_b = wide["n"] - n, wide["b"] - b
        ratio = 2 * (_information(b, n) + _information(rest_b, rest_n) - _information(wide["b"], wide["n"]))
        alone = (n > 0) & (rest_n > 0) & (ratio >= CRITICAL)
        return F.struct(n.alias("n"), b.alias("b"), F.when(alone, (b + PRIOR * wide["p"]) / (n + PRIOR)).otherwise(wide["p"]).alias("p"))

    first = F.get(chain, F.lit(0))
    start = F.struct(first["n"].alias("n"), first["b"].alias("b"), base.alias("p"))
    return F.aggregate(F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0))), start, narrower)["p"]


def judged(tree: DataFrame) -> DataFrame:
    """host, levels, template, purity, learned of each row of ``tree`` (host, site, tld, levels, n, labelled, blocked)."""
    named = materialize(merged(tree), "templates")
    sums = [F.sum("labelled").alias("n"), F.sum("blocked").alias("b")]
    pair = F.struct("n", "b")
    own = named.groupBy("host", "site", "tld", "template").agg(*sums)
    every = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).select(pair.alias("root"))
    # the chain of a template's prefixes, each a hash of the one before it and its own segment
    anywhere = own.groupBy("template").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    hashes = F.aggregate(F.slice(F.split("template", "/"), 2, 1 << 30), F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.xxhash64(F.element_at(a, -1), x)))
    prefixes = materialize(anywhere.select("template", "n", "b", F.posexplode(F.slice(hashes, 2, 1 << 30)).alias("at", "hash")), "prefixes")
    nodes = prefixes.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    found = prefixes.select("template", "at", "hash").join(nodes, "hash").groupBy("template").agg(F.array_sort(F.collect_list(F.struct("at", "n", "b"))).alias("path"))
    pool = lambda keys, name: own.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b")).select(*keys, pair.alias(name))
    joined = own.join(found, "template", "left").join(pool(["tld", "template"], "in_tld"), ["tld", "template"]).join(pool(["site", "template"], "in_site"), ["site", "template"]).join(F.broadcast(every))
    path = F.transform(F.coalesce("path", F.array().cast("array<struct<at:int,n:bigint,b:bigint>>")), lambda x: F.struct(x["n"].alias("n"), x["b"].alias("b")))
    # the template over all hosts is the last prefix; the template of no segments has none and starts from its own pool
    chain = F.concat(F.array("root"), path, F.array("in_tld"), F.array("in_site"), F.array(pair))
    base = F.coalesce(F.col("root.b") / F.nullif(F.col("root.n"), F.lit(0)), F.lit(0.0))
    value = F.round(purity(base, chain), 6)
    verdicts = joined.select("host", "template", value.alias("purity"), F.when(value >= BLOCK, "block").otherwise("allow").alias("learned"))
    return named.select("host", "levels", "template").join(verdicts, ["host", "template"])


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page's url."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    cut = templates(urls)
    tree = cut.groupBy("host", "site", "tld", "levels").agg(F.count("*").alias("n"), F.count("fit.rule_verdict").alias("labelled"), F.count_if(F.col("fit.rule_verdict") == "block").alias("blocked"))
    verdicts = judged(materialize(tree, "tree"))
    out = cut.join(verdicts, ["host", "levels"], "left")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.rule_verdict", "learned", F.lit("allow")).alias("verdict"), "template", "purity")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
