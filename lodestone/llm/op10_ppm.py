"""Language-model scoring by prediction by partial matching.

A text is its words, lower-cased, a blank between two and a line feed at the end; before it stand line feeds. The model is a
trie of the contexts of up to ORDER bytes with the counts of the byte that follows, over all training texts. A byte is
predicted from the longest context that training has seen; where the byte never followed it, the escape probability is paid
(method D: distinct followers over twice the occurrences) and the next shorter context is asked, with the followers
of the longer one excluded from its counts. Last comes the uniform distribution over the bytes that are left.

All symbols that followed a context also followed its suffix, so what is excluded depends on the longer context alone. The
probability of a byte is thus a function of the byte and the ORDER bytes before it: the trie is kept as a table of such grams,
made by grouped sums and joins, and a document's code length is the sum over its grams.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, held_out, table
from lodestone.llm.terms import HEAD, sums, term_counts

ORDER = 5
#: The most grams that are broadcast, at 16 bytes each.
GRAMS = 1 << 20
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """The words and the end; a word can't be the line feed that stands for it."""
    return [*text.lower().split(), END]


def grams(order: int, text: bytes) -> np.ndarray:
    """The grams of order + 1 bytes as numbers, first byte highest, one for each byte."""
    line = b" ".join(text.lower().split()) + END
    x = np.frombuffer(END * order + line, np.uint8).astype(np.int64)
    key = np.zeros(len(line), np.int64)
    for k in range(order + 1):
        key = (key << 8) | x[k : k + len(line)]
    return key


def trie(seen: DataFrame, order: int = ORDER) -> DataFrame:
    """seen: (gram, n, n_train), each gram once. (gram, n, ppm): log10 of the probability of the gram's last byte after the others.

    The grams' endings are counted once for each length, long to short, then valued short to long: each length joins the next
    shorter one and sums over the followers of a context, 256 rows at most. Each step is written down, so no plan holds two.
    """

    def low(c: str, k: int) -> Column:
        """The last k bytes of a gram, as a number."""
        return F.col(c).bitwiseAND(F.lit((1 << 8 * k) - 1))

    # levels[k]: the distinct endings of k + 1 bytes with their counts in training, zero for those seen elsewhere alone.
    levels = [cut(seen.select(F.col("gram").alias("g"), F.col("n").alias("all"), F.col("n_train").alias("n")))]
    for k in range(order, 0, -1):
        levels.insert(0, cut(levels[0].groupBy(low("g", k).alias("g")).agg(F.sum("n").alias("n"))))
    # t, d: how often the context was seen in training and how many bytes followed it. w: log10 of the byte's probability in
    # all shorter contexts when the followers of this one are excluded; used where the byte is not one of them.
    root = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count_if(F.col("n") > 0).alias("d")).first()
    valued = levels[0].withColumns({"t": F.lit(root.t).cast("long"), "d": F.lit(root.d).cast("long"), "w": -F.log10(F.lit(256.0 - min(root.d, 255)))})
    for k in range(1, order + 1):
        shorter = cut(valued).select(F.col("g").alias("g_"), F.col("n").alias("n_"), F.col("t").alias("t_"), F.col("d").alias("d_"), F.col("w").alias("w_"))
        context = Window.partitionBy(F.shiftright("g", 8))
        row = levels[k].join(shorter, low("g", k) == F.col("g_"))
        row = row.withColumns({"t": F.sum("n").over(context), "d": F.count_if(F.col("n") > 0).over(context), "xt": F.sum(F.when(F.col("n") > 0, F.col("n_")).otherwise(0)).over(context)})
        # All followers of a context follow the shorter one too: d of its followers are excluded there, with counts of xt.
        t, d = F.col("t_") - F.col("xt"), F.col("d_") - F.col("d")
        # An unseen context, or one without a byte left, passes the byte on at no cost.
        w = F.when(F.col("n") > 0, None).when(F.col("n_") > 0, F.log10((2 * F.col("n_") - 1) / (2 * t))).when((F.col("t_") > 0) & (d > 0), F.log10(d / (2 * t)) + F.col("w_")).otherwise(F.col("w_"))
        valued = row.select(*levels[k].columns, "t", "d", w.alias("w"))
    p = F.when(F.col("n") > 0, F.log10((2 * F.col("n") - 1) / (2 * F.col("t")))).when(F.col("t") > 0, F.log10(F.col("d") / (2 * F.col("t"))) + F.col("w")).otherwise(F.col("w"))
    return valued.select(F.col("g").alias("gram"), F.col("all").alias("n"), p.alias("ppm"))


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, head: int = HEAD, gram_head: int = GRAMS) -> DataFrame:
    """One row per row of docs: the id, n_tokens, n_known, train_tokens, base_score and score.

    train: a column of docs, true for the rows that are learned from; null counts as false. base_score is the log10
    probability of the tokens by their add-one frequencies, score that of the text by the model. A null or empty text is the
    end alone. Null ids and repeated rows stay; repeated rows count as often as they occur. Without a training row score is
    that of uniform bytes. Only the named columns are read. An empty table gives no rows. Texts of any length are read whole.
    """
    if not 0 <= order <= 6:
        raise ValueError("order must be 0 to 6: a gram is a number of 56 bits")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    # size: tokens, the end included.
    n = F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("rid"), n.cast("long").alias("size"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = cut(term_counts(rows, tokens, train=F.col("train")))
    total = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("n_train") > 0, 1)).alias("kinds")).first()
    base = F.log10((F.col("n_train") + 1) / F.lit(float(total.tokens + total.kinds + 1)))
    valued = words.withColumns({"base_score": base, "n_known": (F.col("n_train") > 0).cast("double")})
    first = sums(rows, tokens, valued, {"base_score": F.lit(0.0), "n_known": F.lit(0.0)}, head)

    seen = term_counts(rows, partial(grams, order), train=F.col("train"), kind="long")
    model = cut(trie(seen.withColumnRenamed("term", "gram"), order).withColumnRenamed("gram", "term"))
    second = sums(rows, partial(grams, order), model, {"ppm": F.lit(0.0)}, gram_head)
    # Both hold as many rows of a text as docs does, and equal ones: one row of each suffices.
    second = second.groupBy("id", "rid").agg(F.first("ppm").alias("score")).select(F.col("id").alias("id_"), F.col("rid").alias("rid_"), "score")
    out = first.join(second, (F.col("rid") == F.col("rid_")) & F.col("id").eqNullSafe(F.col("id_")))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"), F.lit(int(total.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7)
    return score_texts(table(spark, sf_dir, "documents"), ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_ppm": op10_ppm}
ORACLES: dict[str, str] = {}
