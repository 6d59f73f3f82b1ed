"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every normalised line is hashed; lines that too many distinct documents of one host hold are boilerplate there and are removed.
A document that keeps too few of its words without them is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, cut, fresh, lower_ascii, table, word_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A line goes that over LINE_DOCS distinct documents and LINE_SHARE of all documents of its host hold, but for the smallest id.
LINE_DOCS, LINE_SHARE = 5, 0.1
#: A document goes that keeps under this share of its words, or under MIN_WORDS of them.
KEPT_SHARE = 0.3


def _n(x: Column) -> Column:
    return F.size(x).cast("long")


def line_hash(line: Column) -> Column:
    """Of a line with runs of white space as one blank, none at the ends, and A-Z lower-cased."""
    return F.xxhash64(lower_ascii(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; keeps `lines`, an array of (h, words).

    A null text has no words and no lines. Windows are compared by 64-bit hash within their document.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.withColumn("_w", word_array(t)).withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    # Sorted (hash, position) of the 3-word windows; a neighbour with the same hash marks a window that occurs again.
    n = F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1)).alias("h"), i.alias("i"))))
    words = words.withColumn("_s", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    words = words.withColumn("_h", F.transform("_s", lambda x: x.h)).withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, k: (F.get("_h", k + 1) == x.h) | ((k > 0) & (F.get("_h", k - 1) == x.h))), lambda x: x.i)))
    gaps = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1), p + 3) - p))
    words = words.withColumn("n_words", _n(F.col("_w"))).withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))
    out = words.withColumns(
        {
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _n(F.col("_l")) - _n(F.array_distinct("_l")),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "lines": F.transform("_l", lambda x: F.struct(line_hash(x).alias("h"), F.size(word_array(x)).alias("words"))),
        }
    )
    return out.drop("_w", "_l", "_s", "_h", "_p")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, kept_share: float = KEPT_SHARE
) -> DataFrame:
    """One row per row of docs: rid, the id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words,
    base_failed, kept, text_hash and gone (hashes of the lines that go, null for none; quality_filter() takes them out).

    Line frequency counts distinct documents (ids; rows with a null id by their text) of a host. The smallest id of the host that
    holds a line keeps it: copies of one text may be over the limit, and then one of them stays for the dedup. Only the named columns are read. A null host is a host of its own. A null or empty text fails the base rules. Repeated rows stay and fare
    alike. An empty table gives no rows. Documents of any length are one row; a host may hold most rows, as its lines are
    counted by (host, line).
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    base = cut(base_rules(read.withColumn("text_hash", F.xxhash64("text"))).drop("text").withColumn("rid", F.monotonically_increasing_id()))
    doc = F.when(F.col("id").isNull(), F.col("text_hash")).otherwise(F.xxhash64(F.col("id").cast("string")))
    docs_n = base.select("host", doc.alias("doc")).distinct().groupBy("host").agg(F.count("*").alias("n"))
    lines = (
        base.select("id", "host", doc.alias("doc"), F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h"))
        .groupBy("host", "h", "doc").agg(F.min("id").alias("id"))
        .groupBy("host", "h").agg(F.count("*").alias("held"), F.min("id").alias("keeper")).where(F.col("held") > line_docs)
    )
    limit = docs_n.select(F.col("host").alias("host_"), "n")
    # Written before it is joined: Spark broadcasts it by its size, or splits a line with most rows.
    common = cut(lines.join(limit, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("held") > line_share * F.col("n")).select("host_", "h", "keeper"))
    held = base.select("rid", "id", "host", F.explode("lines").alias("x")).select("rid", "id", "host", "x.h", "x.words")
    gone = held.join(common, (held.h == common.h) & held.host.eqNullSafe(common.host_)).where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("rid").agg(F.sum("words").alias("n_common_words"), F.collect_set(held.h).alias("gone"))
    out = base.drop("lines").join(gone, "rid", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_common_words")
    depleted = (F.col("n_common_words") > 0) & ((left < kept_share * F.col("n_words")) | (left < MIN_WORDS))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        "rid", F.col("id").alias(id_col), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words", "text_hash", "gone"
    )


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """docs, with its columns, without the rows that quality_rules() rejects and without the lines that go from the others. A row
    that loses no line keeps its text as it is, null included."""
    verdict = quality_rules(docs.select(id_col, host_col, text_col), id_col, text_col, host_col, **options).where("NOT kept OR gone IS NOT NULL")
    names = {c: fresh(docs, f"{c}_") for c in ("id", "hash", "host", "kept", "gone")}
    verdict = verdict.select(F.col(id_col).alias(names["id"]), F.col("text_hash").alias(names["hash"]), F.col("host").alias(names["host"]), F.col("kept").alias(names["kept"]), F.col("gone").alias(names["gone"]))
    # Equal rows fare alike: one verdict for each.
    verdict = verdict.dropDuplicates([names["id"], names["hash"], names["host"]])
    same = F.col(id_col).eqNullSafe(F.col(names["id"])) & (F.xxhash64(text_col) == F.col(names["hash"])) & F.col(host_col).cast("string").eqNullSafe(F.col(names["host"]))
    out = docs.join(verdict, same, "left").where(F.coalesce(names["kept"], F.lit(True)))
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(names["gone"], line_hash(x))), "\n")
    return out.withColumn(text_col, F.when(F.col(names["gone"]).isNull(), F.col(text_col)).otherwise(left)).select(docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("rid", "host", "text_hash", "gone")


QUERIES = {"op7_quality": op7_quality}
ORACLES = {
    "op7_quality": r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
s AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM s) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, unnest(l) AS line FROM d),
keyed AS (
  SELECT doc_id, host, text, translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM lines),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
common AS (SELECT k.host, k.k, min(k.doc_id) AS keeper FROM keyed k JOIN hosts h ON k.host IS NOT DISTINCT FROM h.host GROUP BY k.host, k.k, h.n HAVING count(DISTINCT k.doc_id) > 5 AND count(DISTINCT k.doc_id) > 0.1 * h.n),
gone AS (SELECT doc_id, sum(words) AS n FROM keyed k JOIN common c ON k.k = c.k AND k.host IS NOT DISTINCT FROM c.host WHERE k.doc_id <> c.keeper GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_common_words
  FROM d LEFT JOIN rw ON d.doc_id = rw.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (n_common_words > 0 AND (n_words - n_common_words < 0.3 * n_words OR n_words - n_common_words < 50)) AS kept FROM judged
"""
}
