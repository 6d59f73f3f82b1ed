"""Tables of phrases found in texts: runs of words meet the table by equality, so it may hold any number of phrases.

A text is cut into words (letters, digits and underscores) and what lies between them. A phrase is such a run, from its first
word to its last; it is found where a text has the same run, without regard to case, with the same signs between the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.store import cut
from lodestone.functions.text import let

_SIGN = r"[\p{L}\p{N}_]"
_PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_EDGES = r"\A[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+\z"


def pieces(text: Column) -> Column:
    """Words and what lies between them, in turn, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(_PIECES), F.lit(0))


def run_of(phrase: Column) -> Column:
    """A phrase as it is looked for: in lower case, from its first word to its last; empty without a word."""
    return F.regexp_replace(F.lower(phrase), _EDGES, "")


def runs(text: Column, sizes: Column) -> Column:
    """Array of (at, run) of all runs of so many pieces, an odd number, that begin with a word; at is the word's place, from 1."""
    none = F.array().cast("array<struct<at:int,run:string>>")

    def of(p: Column) -> Column:
        first = F.when(F.coalesce(F.get(p, F.lit(0)), F.lit("")).rlike(rf"\A{_SIGN}"), 1).otherwise(2)

        def of_size(m: Column) -> Column:
            run = lambda i: F.struct(F.ceil(i / 2).cast("int").alias("at"), F.array_join(F.slice(p, i, m), "").alias("run"))
            return F.when(F.size(p) - m + 1 >= first, F.transform(F.sequence(first, F.size(p) - m + 1, F.lit(2)), run)).otherwise(none)

        return F.flatten(F.transform(sizes, of_size))

    return let(pieces(F.coalesce(text, F.lit(""))), of)


def hits(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_col: str = "phrase") -> DataFrame:
    """(id, phrase, n, first_at): how often each text has each phrase, and the place of the first, in words from 1.

    Phrases that agree but for case and edges are each found; one without a word is found nowhere, nor is any in a null or empty
    text. Rows of one id count together, null ids too. Either table may be empty. Runs are made where the texts are read, for the
    numbers of words that phrases have; a table that Spark finds small goes to all tasks and no text is shuffled, a large one
    meets the runs in a shuffle. It holds a run once and is written first, so that Spark splits a run that most texts have.
    """
    named = phrases.select(F.col(phrase_col).alias("phrase"), run_of(F.col(phrase_col)).alias("run")).where("run <> ''").distinct()
    table = cut(named.groupBy("run").agg(F.collect_set("phrase").alias("phrases")).withColumn("size", F.size(pieces(F.col("run")))))
    sizes = table.agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    found = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).crossJoin(F.broadcast(sizes)).select("id", F.explode(runs(F.col("text"), F.col("sizes"))).alias("r"))
    met = found.select("id", "r.at", "r.run").join(table.select("run", "phrases"), "run")
    counted = met.groupBy("id", "run", "phrases").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    return counted.select(F.col("id").alias(id_col), F.explode("phrases").alias("phrase"), "n", "first_at")


def expanded(texts: DataFrame, text_col: str, table: DataFrame, name: str = "expanded") -> DataFrame:
    """texts with `name`: the text and, once each and in the table's order, the words of the phrases that it has.

    table: (phrase, words, place), words being an array and place its order. A null text stays null; equal texts are
    looked up once. What one text gathers is bounded by the phrases that stand in it.
    """
    distinct = texts.select(F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_t")).dropDuplicates(["_th"])
    found = hits(distinct, "_th", "_t", table).join(table.select("phrase", "words", "place"), "phrase")
    extra = found.groupBy("_th").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("_x"))
    extra = cut(extra.select("_th", F.array_join(F.array_distinct(F.flatten(F.transform("_x", lambda x: x.words))), " ").alias("_more")))
    out = texts.withColumn("_th", F.xxhash64(text_col)).join(extra, "_th", "left")
    return out.withColumn(name, F.when(F.coalesce("_more", F.lit("")) != "", F.concat(text_col, F.lit(" "), "_more")).otherwise(F.col(text_col))).drop("_th", "_more")


def labels(texts: DataFrame, id_col: str, text_col: str, table: DataFrame) -> DataFrame:
    """table: (label, phrase). (id, label, score, rank): how many of a label's distinct phrases each text has, the best label
    first, then by name. Texts without a phrase have no row."""
    own = table.select("label", "phrase").where("label IS NOT NULL").distinct()
    scored = hits(texts, id_col, text_col, own).join(own, "phrase").groupBy(id_col, "label").agg(F.countDistinct(run_of(F.col("phrase"))).alias("score"))
    # A text has at most as many labels as it has phrases: they are put in order as one array, not by a window over all.
    best = scored.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "label"))).alias("l"))
    return best.select(id_col, F.posexplode("l").alias("i", "x")).select(id_col, "x.label", (-F.col("x.less")).alias("score"), (F.col("i") + 1).alias("rank"))
