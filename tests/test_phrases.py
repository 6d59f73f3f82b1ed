import random
import re

from pyspark.sql import functions as F

from lodestone.operators import phrases, search


def _brute(text, phrase):
    """(how often, place of the first) of a phrase between the edges of words, runs that overlap included."""
    low, run = (text or "").lower(), re.sub(r"^\W+|\W+$", "", phrase.lower())
    at = [m.start() for m in re.finditer(rf"(?<!\w)(?={re.escape(run)}(?!\w))", low)] if run else []
    return (len(at), len(re.findall(r"\w+", low[: at[0]])) + 1) if at else None


def test_hits_against_brute_force(spark):
    r = random.Random(4)
    words, gaps = ["a", "b", "free", "look", "été", "x1", "_"], [" ", "-", ", ", "  ", "\n"]
    say = lambda n: "".join(r.choice(words) + r.choice(gaps) for _ in range(n))
    texts = [(i, r.choice(["", " ", "("]) + say(r.randint(0, 30))) for i in range(120)] + [(900, None), (901, ""), (902, " - "), (903, "A a A a A")]
    table = sorted({say(r.randint(1, 4)) for _ in range(60)} | {"a b", "A-b", "free-look", "a", " a ", "a a a", "--", ""})
    docs = spark.createDataFrame(texts, "id long, text string")
    got = phrases.hits(docs, "id", "text", spark.createDataFrame([(p,) for p in table] + [(None,), ("a",)], "phrase string"))
    want = {(i, p, *f) for i, t in texts for p in table if (f := _brute(t, p))}
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_hits_of_a_large_table_by_shuffle(spark):
    """Without a broadcast the rows are the same; a run that most texts have is one row of the table."""
    docs = spark.range(400).select("id", F.concat(F.lit("the common words and w"), "id", F.lit(" at the end")).alias("text"))
    table = spark.range(5000).select(F.concat(F.lit("W"), "id", F.lit(" at")).alias("phrase")).union(spark.createDataFrame([("common words",)], "phrase string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(x) for x in phrases.hits(docs, "id", "text", table).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == sorted([(i, "common words", 1, 2) for i in range(400)] + [(i, f"W{i} at", 1, 5) for i in range(400)])


def test_hits_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (None, "a"), (None, "a a")], "id long, text string"), spark.createDataFrame([], "phrase string")
    assert phrases.hits(docs, "id", "text", none).count() == 0
    one = spark.createDataFrame([("a",)], "phrase string")
    assert phrases.hits(docs.where("false"), "id", "text", one).count() == 0
    assert sorted(map(tuple, phrases.hits(docs, "id", "text", one).collect()), key=str) == [(1, "a", 1, 1), (None, "a", 3, 1)]


def test_expansion_equals_that_by_columns(spark):
    said = ["What does it cost for kids?", "price, COST and old-age costs", "blood pressure", "blood  pressure", "bloodpressure", "cancel the plan, refund", "", None, "dp? jatuh tempo", "after how long"]
    asked = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(said * 2)], "id int, text string")
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(search.SYNONYMS.items())], "phrase string, words array<string>, place int")
    got = phrases.expanded(asked, "text", table)
    want = asked.select("id", "text", search.expand(F.col("text"), search.SYNONYMS).alias("expanded"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 20


def test_labels_by_distinct_phrases(spark):
    table = spark.createDataFrame([("claims", "claim"), ("claims", "network hospital"), ("claims", "Claim"), ("price", "premium"), ("price", "discount"), (None, "x")], "label string, phrase string")
    docs = spark.createDataFrame([(1, "A claim, a claim at a network hospital; the premium"), (2, "premium of a claim"), (3, "x"), (4, None)], "id long, text string")
    got = sorted(tuple(x) for x in phrases.labels(docs, "id", "text", table).collect())
    assert got == [(1, "claims", 2, 1), (1, "price", 1, 2), (2, "claims", 1, 1), (2, "price", 1, 2)]
