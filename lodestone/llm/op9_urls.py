"""URL filters: rules for hosts and paths, and for the rest trust and distrust that spread over the link graph of hosts.

Trust starts at hosts whose pages the rules allow and follows links (personalised PageRank); distrust starts at hosts whose
pages the rules block and goes against the links, to the hosts that point at them. A host is blocked where its distrust
outweighs its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, lower_ascii, table

DAMPING, TOLERANCE = 0.85, 1e-6
#: A host is blocked if its distrust is over so many times its trust.
OUTWEIGHS = 1.0
#: (verdict, rule): host, then path from the first slash on.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    rows = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: distinct (host, path). (host, path, rule, verdict) of those that a rule fits; the longest rule wins."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    fits = urls.withColumn("rule_host", suffix).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host")))
    return fits.groupBy("host", "path").agg(best.alias("x")).select("host", "path", "x.rule", "x.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """(u, v, n): on how many pages host u links to another host v. Relative links stay on their host and give nothing."""
    target = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1), lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)))))
    return pages.select(F.col("host").alias("u"), target.alias("v")).where("u <> v AND u <> '' AND v <> ''").groupBy("u", "v").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """edges: (u, v, n). seeds: (host, mass), masses of 1 in all. (host, score): personalised PageRank, by power iteration until
    it changes by less than the tolerance in all, as it must: each round's change is at most `damping` times the last one's.
    What hosts without links hold goes back to the seeds."""
    if not 0 <= damping < 1:
        raise ValueError("damping must be below 1")
    out_n = edges.groupBy("u").agg(F.sum("n").alias("whole"))
    share = cut(edges.join(out_n, "u").select("u", "v", (F.col("n") / F.col("whole")).alias("w")))
    now = seeds.select("host", F.col("mass").alias("score"))
    while True:
        flow = now.join(share, now.host == share.u)
        moved = flow.groupBy(F.col("v").alias("host")).agg(F.sum(F.col("score") * F.col("w")).alias("come"))
        sent = flow.agg(F.coalesce(F.sum(F.col("score") * F.col("w")), F.lit(0.0)).alias("sent")).first()["sent"]
        back = 1.0 - damping * sent  # of all mass 1: the restart, and what found no link
        new = seeds.select("host", "mass").join(moved, "host", "full").select("host", (back * F.coalesce("mass", F.lit(0.0)) + damping * F.coalesce("come", F.lit(0.0))).alias("score"))
        new = cut(new)
        off = new.join(now.withColumnRenamed("score", "old"), "host", "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))), F.lit(0.0)).alias("off")).first()["off"]
        now = new
        if off < tolerance:
            return now


def _seeds(counts: DataFrame, column: str) -> DataFrame:
    total = counts.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
    return counts.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(max(1, total)))).alias("mass"))


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", outweighs: float = OUTWEIGHS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of pages: the id, host, path, rule, verdict, trust and distrust (of the host).

    A url without :// or null has an empty host and path: no rule fits, it has no links, and it is allowed. A null html has no
    links. Null and repeated ids and repeated rows stay; repeated rows count as pages of their own. Hosts that neither trust
    nor distrust reaches are allowed. Only the named columns are read. An empty table gives no rows. A host may have most
    pages or links: pages are counted by host and links by pair of hosts before they are joined.
    """
    spark = pages.sparkSession
    read = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    ruled = cut(match_rules(read.select("host", "path").distinct(), rule_table(spark, rules)))
    judged = cut(read.select("id", "host", "path").join(ruled, ["host", "path"], "left"))
    counts = cut(judged.where("host <> ''").groupBy("host").agg(*(F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block"))))
    edges = cut(host_links(read))
    trust = propagate(edges, cut(_seeds(counts, "allow")), damping, tolerance)
    distrust = propagate(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "n"), cut(_seeds(counts, "block")), damping, tolerance)
    # Written, so that Spark broadcasts it by its size or splits a host with most pages.
    of_host = cut(trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full"))
    out = judged.join(of_host, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") > outweighs * F.col("trust"), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "trust", "distrust")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


QUERIES = {"op9_urls": op9_urls}
ORACLES: dict[str, str] = {}
