"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share of the mix, in words. Within a source each document is expected `m` times, in proportion to
its sampling weight; floor(m) copies are certain and the rest of m is the inclusion probability of one more. Documents are
ranked by random odds over inclusion odds, and taken in that order until the source's words are full; the last place goes to
the document that fits it best. So the size of the sample, in words, is fixed and only its members are random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table, word_array

WEIGHTS, SHARE, MAX_COPIES, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 7
#: Scraps of fewer words, and documents of as many as the second number or more, are sampled with half the weight of others.
SCRAP, HUGE = 16, 4096
#: Ranks are cut into so many bins, and the bin that holds the cut into so many again.
BINS = 1024


def water_fill(rows: DataFrame, by: list[str], cap: Column, weight: Column, budget: Column, name: str) -> DataFrame:
    """Adds `name`: budget shared by weight within each group, no row above its cap, what is over shared again until none is.

    rows holds aggregates (one row for each source, or source and class). Sorted by cap / weight, the capped rows come first.
    """
    order = W.partitionBy(*by).orderBy("_ratio", "_cap") if by else W.orderBy("_ratio", "_cap")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    out = rows.withColumns({"_cap": cap.cast("double"), "_weight": weight.cast("double")})
    out = out.withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(0.0))
    out = out.withColumn("_level", (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.nullif(F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("_level").alias("l")))).over(whole).getField("l"))
    return out.withColumn(name, F.when(F.col("_level").isNull() | (F.col("_ratio") < F.col("_level")), F.col("_cap")).otherwise(F.col("_weight") * F.col("_level"))).drop("_cap", "_weight", "_ratio", "_level")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """sizes: (source, source_size). Adds target. Weights go round the sources in code point order, null last."""
    ranked = sizes.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    total = F.lit(share) * F.sum("source_size").over(W.partitionBy(F.lit(1)))
    ranked = ranked.withColumns({"_w": weight, "_total": total})
    return water_fill(ranked, [], F.lit(max_copies) * F.col("source_size"), F.col("_w"), F.col("_total"), "target").drop("_n", "_w", "_total")


def _cum(by: list[str], order: str) -> Column:
    return F.sum("words").over(W.partitionBy(*by).orderBy(order))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: rid (row_col, a number of its own for each row, where docs has one; else a new one), the id,
    source, size, source_size, target, copies, taken.

    A null text has size 0; a null source is a source, the last. Rows are drawn by id and size; those that agree in both are
    numbered, by text, and drawn apart, so repeated rows and null ids are sampled like others. Which of equal rows is taken
    makes no difference. A source without a word has target 0, and documents without a word are never taken. An empty table
    gives no rows. Only the named columns are read, so others may have any name. A source may hold most rows: no step gathers
    the rows of a source; the cut is found by summing words in bins of ranks, and only the last bin's rows, about a millionth
    of the source, are put in order. What goes through one task is one row for each source, and a sort of the (narrow) rows
    that agree in id and size.
    """
    rid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = F.col(text_col)
    sized = docs.select(rid.alias("rid"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(word_array(text)).cast("long").alias("size"), F.xxhash64(text).alias("th"))
    # Null ids are spread by their text before they are numbered.
    alike = W.partitionBy("id", "size", F.when(F.col("id").isNull(), F.col("th"))).orderBy("th", "rid")
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.col("th").cast("string")))
    nth = F.row_number().over(alike)
    key = F.concat_ws(":", name, F.col("size"), F.lit(seed), F.when(nth > 1, nth))
    sized = cut(sized.withColumn("key", key).drop("th"))
    # Sources join on a key that is never null.
    sized = sized.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sized = sized.withColumn("w", F.when((F.col("size") < SCRAP) | (F.col("size") >= HUGE), 0.5).otherwise(1.0))
    classes = sized.groupBy("s", "source", "w").agg(F.sum("size").alias("class_size"))
    sources = source_targets(classes.groupBy("s", "source").agg(F.sum("class_size").alias("source_size")), weights, share, max_copies)
    classes = water_fill(classes.join(sources.drop("source"), "s"), ["s"], F.lit(max_copies) * F.col("class_size"), F.col("w") * F.col("class_size"), F.col("target"), "class_words")
    expected = F.round(F.when(F.col("class_size") > 0, F.col("class_words") / F.col("class_size")).otherwise(0.0), 9)
    classes = cut(classes.withColumn("m", expected).withColumn("sure", F.floor("m")).withColumn("p", F.col("m") - F.col("sure")))
    rest = classes.groupBy("s").agg((F.first("target") - F.sum(F.col("sure") * F.col("class_size"))).alias("rest"))
    docs_ = sized.join(classes.select("s", "w", "source_size", "target", "sure", "p"), ["s", "w"])
    draw = (F.conv(F.substring(F.md5("key"), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = docs_.withColumn("u", draw).withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
    ranked = cut(ranked.withColumn("r", F.col("q") / (1 + F.col("q"))).withColumns({"b1": F.floor(F.col("r") * BINS).cast("int"), "b2": (F.floor(F.col("r") * BINS * BINS) % BINS).cast("int")}).drop("u", "q", "w", "key"))
    drawn = ranked.where("r IS NOT NULL")
    # The first bin that overfills a source, then the first bin within it, then the rows of that one.
    first = drawn.groupBy("s", "b1").agg(F.sum("size").alias("words")).withColumn("cum", _cum(["s"], "b1")).join(rest, "s").where("cum > rest")
    first = first.groupBy("s").agg(F.min_by(F.struct("b1", (F.col("rest") - F.col("cum") + F.col("words")).alias("rest")), "b1").alias("x")).select("s", "x.*")
    second = drawn.join(first, ["s", "b1"]).groupBy("s", "b1", "rest", "b2").agg(F.sum("size").alias("words")).withColumn("cum", _cum(["s"], "b2")).where("cum > rest")
    second = cut(second.groupBy("s").agg(F.min_by(F.struct("b1", "b2", (F.col("rest") - F.col("cum") + F.col("words")).alias("rest")), "b2").alias("x")).select("s", "x.*"))
    order = W.partitionBy("s").orderBy("r", F.col("id").asc_nulls_first(), "size", "rid")
    last = drawn.join(second, ["s", "b1", "b2"]).withColumn("cum", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    fits = cut(last.withColumn("fits", F.col("cum") <= F.col("rest")).select("s", "rid", "size", "fits"))
    gap = second.join(fits.where("fits").groupBy("s").agg(F.sum("size").alias("in_last")), "s", "left").select("s", F.col("b1").alias("c1"), F.col("b2").alias("c2"), (F.col("rest") - F.coalesce("in_last", F.lit(0))).alias("gap"))
    # Those beyond the cut; the one whose size is nearest to what is left comes in if that brings the source nearer.
    beyond = drawn.join(gap, "s").where((F.col("b1") > F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") >= F.col("c2")))).join(fits.where("fits").select("s", "rid"), ["s", "rid"], "left_anti")
    best = beyond.where(F.abs(F.col("gap") - F.col("size")) < F.col("gap")).groupBy("s").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "r", "id", "rid")).alias("x")).select("s", F.col("x.rid").alias("rid"))
    extra = fits.where("fits").select("s", "rid").union(best).withColumn("more", F.lit(1))
    out = ranked.join(second.select("s", F.col("b1").alias("c1"), F.col("b2").alias("c2")), "s", "left").join(extra, ["s", "rid"], "left")
    inside = F.col("r").isNotNull() & (F.col("c1").isNull() | (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.when(inside | F.col("more").isNotNull(), 1).otherwise(0)).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select("rid", F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mix": op3_mix}
ORACLES = {
    "op3_mix": r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
dw AS (SELECT *, CASE WHEN size < 16 OR size >= 4096 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d),
src AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt FROM d GROUP BY source),
sr AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / wt AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM src),
sl AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0::DOUBLE)) AS level FROM sr
       WINDOW b AS (ORDER BY ratio, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sx AS (SELECT *, min(CASE WHEN level <= ratio THEN {'ratio': ratio, 'l': level} END) OVER () AS best FROM sl),
st AS (SELECT source, source_size, CASE WHEN best IS NULL OR ratio < best.l THEN cap ELSE wt * best.l END AS target FROM sx),
cl AS (SELECT dw.source, dw.w, sum(size)::BIGINT AS class_size FROM dw GROUP BY ALL),
cr AS (SELECT cl.*, st.source_size, st.target, 2.0::DOUBLE * class_size AS cap, cl.w * class_size AS wt, CASE WHEN class_size > 0 THEN 2.0::DOUBLE * class_size / (cl.w * class_size) ELSE 0.0::DOUBLE END AS ratio
       FROM cl JOIN st ON cl.source IS NOT DISTINCT FROM st.source),
ck AS (SELECT *, (target - coalesce(sum(cap) OVER b, 0::DOUBLE)) / nullif(sum(wt) OVER (PARTITION BY source) - coalesce(sum(wt) OVER b, 0::DOUBLE), 0) AS level FROM cr
       WINDOW b AS (PARTITION BY source ORDER BY ratio, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cx AS (SELECT *, min(CASE WHEN level <= ratio THEN {'ratio': ratio, 'l': level} END) OVER (PARTITION BY source) AS best FROM ck),
cm AS (SELECT *, CASE WHEN class_size > 0 THEN round((CASE WHEN best IS NULL OR ratio < best.l THEN cap ELSE wt * best.l END) / class_size, 9) ELSE 0.0::DOUBLE END AS m FROM cx),
cp AS (SELECT *, floor(m) AS sure, m - floor(m) AS p FROM cm),
rest AS (SELECT source, any_value(target) - sum(sure * class_size) AS rest FROM cp GROUP BY source),
dj AS (SELECT dw.*, cp.source_size, cp.target, cp.sure, cp.p, (('0x' || substr(md5(doc_id || ':' || size || ':7'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
       FROM dw JOIN cp ON dw.source IS NOT DISTINCT FROM cp.source AND dw.w = cp.w),
dq AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM dj),
dr AS (SELECT dq.*, q / (1 + q) AS r, rest.rest FROM dq JOIN rest ON dq.source IS NOT DISTINCT FROM rest.source),
dc AS (SELECT *, CASE WHEN r IS NOT NULL THEN sum(size) OVER (PARTITION BY source, r IS NULL ORDER BY r, doc_id ROWS UNBOUNDED PRECEDING) <= rest END AS fits FROM dr),
ds AS (SELECT *, min(CASE WHEN NOT fits THEN r END) OVER (PARTITION BY source) AS cut FROM dc),
dg AS (SELECT *, rest - coalesce(sum(CASE WHEN r < cut THEN size END) OVER (PARTITION BY source), 0) AS gap FROM ds),
dn AS (SELECT *, CASE WHEN cut IS NOT NULL AND r >= cut AND abs(gap - size) < gap THEN row_number() OVER (PARTITION BY source, (cut IS NOT NULL AND r >= cut AND abs(gap - size) < gap) ORDER BY abs(gap - size), r, doc_id) END AS nth FROM dg)
SELECT doc_id, size, source_size, target, (size * (sure + CASE WHEN r IS NOT NULL AND (cut IS NULL OR r < cut) OR nth = 1 THEN 1 ELSE 0 END))::BIGINT AS taken FROM dn
"""
}
