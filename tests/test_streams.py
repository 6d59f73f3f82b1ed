"""Streams against the batch operators, for different splits into batches."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dialogue, live
from lodestone.plans import tables as T
from lodestone.streaming.nudges import distinct_stream, line_nudges, rocksdb

LINE = "conv string, turn long, text string, role string, ts timestamp"


def run(spark, tmp_path, batches, schema, of, name, far=True):
    """The rows that `of` gives for a stream whose batches are given one after the other; a far later line ends it, twice."""
    source = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b{i:03d}"))
    rocksdb(spark)
    got = None
    for i in range(len(batches)):
        # One trigger for each batch, in this order, with one checkpoint.
        (source / "in").mkdir(exist_ok=True)
        for f in (source / f"b{i:03d}").glob("*.parquet"):
            f.rename(source / "in" / f"{i:03d}-{f.name}")
        stream = of(spark.readStream.schema(schema).parquet(str(source / "in")))
        q = stream.writeStream.format("parquet").option("path", str(source / "out")).option("checkpointLocation", str(source / "ck")).outputMode("append").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
    got = spark.read.parquet(str(source / "out")).collect()
    return got


def lines_of(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 8").orderBy("conv_id", "turn").collect()
    script = ["Good day, approval is guaranteed", "This is ridiculous!!", "too expensive, mahal banget", "call me back", "a second car, a second car", "a second car, a second car again"]
    return [(str(r.conv_id), r.turn, f"{script[(r.conv_id + r.turn) % 6]} {r.text[:200] if r.text else ''}", r.role, 1_700_000_000 + 5 * r.turn + r.conv_id) for r in rows]


def stamped(rows):
    import datetime

    return [(*x[:4], datetime.datetime.fromtimestamp(x[4], datetime.UTC).replace(tzinfo=None)) for x in rows]


def wanted(spark, rows):
    lines = spark.createDataFrame([x[:4] for x in rows], "conv string, turn long, text string, role string")
    clocked = live.with_clock(lines, "conv", "turn", "text").withColumn("speaker", live.speaker_of(F.col("role")))
    got = live.nudges(live.signals(clocked, "conv", "turn", "text"), "conv", ["turn", "seq"])
    return sorted((r.call, r.id, r.kind, r.confidence, r.priority, round(r.created_t, 6), round(r.expires_t, 6), r.evidence, r.suppressed, r.reason or "") for r in got.collect())


def shown(rows):
    return sorted((r.call, r.id, r.kind, r.confidence, r.priority, round(r.created_t, 6), round(r.expires_t, 6), r.evidence, r.suppressed, r.reason or "") for r in rows if r.call != "far")


def of(**options):
    return lambda s: line_nudges(s, "conv", "turn", "text", "role", "ts", late="40 seconds", **options)


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 4)])
def test_raw_lines_equal_the_batch(spark, tmp_path, seed, n):
    rows, rng = lines_of(spark), random.Random(seed)
    came = sorted(rows, key=lambda x: (x[4] + rng.choice([0, 0, 7, 12]), x[0]))  # out of order by some turns
    batches = [stamped(came[i * len(came) // n : (i + 1) * len(came) // n]) for i in range(n)]
    want = wanted(spark, rows)
    assert shown(run(spark, tmp_path, batches, LINE, of(), f"s{seed}")) == want
    assert {"compliance_gap", "rising_frustration"} <= {x[2] for x in want} and {"cooldown", ""} <= {x[9] for x in want}
    assert any(x[7] == "No disclosure heard." for x in want)


def test_lost_and_late_lines_and_silent_calls(spark, tmp_path):
    t0 = 1_700_000_000
    line = lambda conv, turn, text, at, role="agent": (conv, turn, text, role, t0 + at)
    first = [line("a", 0, "this call is being recorded", 0), line("a", 2, "approval is guaranteed", 10), line("b", 1, "call me back", 5, "user"), line("c", 0, "guaranteed", 3)]
    second = [line("c", 1, "guaranteed again, as I say it now", 60), line("far", 0, "x", 200)]  # the watermark passes the turns that a and b wait for
    third = [line("a", 1, "guaranteed, too late", 190), line("a", 3, "no exclusions in it", 195, "agent"), line("b", 0, "late", 190, "user"), line("far", 1, "x", 5000)]
    fourth = [line("c", 0, "guaranteed", 5001), line("far", 2, "x", 6000)]  # c was silent for over an hour: a call of its own
    got = run(spark, tmp_path, [stamped(x) for x in (first, second, third, fourth)], LINE, of(wait_ms=60_000, idle_ms=3_600_000), "lost")
    calls = {c: sorted((r.turn, r.id, r.kind, r.reason or "") for r in got if r.call == c) for c in "abc"}
    # Turn 1 of a never came in time: 2 is taken without it, and 1 is left out when it comes.
    assert calls["a"] == [(2, "N001", "compliance_gap", ""), (3, "N002", "compliance_gap", "cooldown")]
    assert calls["b"] == [(1, "N001", "callback_need", "")]
    assert [x[1] for x in calls["c"]].count("N001") == 2 and calls["c"][0][0] == 0


def test_signal_union_equals_the_batch(spark, tmp_path):
    import datetime

    rng = random.Random(4)
    schema = "conv string, turn long, seq int, kind string, confidence double, evidence string, t_end double, speaker string, ts timestamp, model boolean"
    at = lambda t: datetime.datetime.fromtimestamp(1_700_000_000 + t, datetime.UTC).replace(tzinfo=None)
    rows = [(f"c{rng.randrange(3)}", turn, rng.randrange(3), rng.choice("ab"), round(rng.random(), 3), rng.choice(["x" * 90 + "1", "x" * 90 + "2", "y"]), float(turn), "agent", at(turn), rng.random() < 0.5) for turn in range(40) for _ in range(3)]
    rows = list({(x[0], x[1], x[2], x[3], x[5][:80], x[9]): x for x in rows}.values())  # a rule gives a signal of a line once
    df = spark.createDataFrame(rows, schema).drop("ts")
    want = sorted(tuple(r) for r in live.distinct_signals(df.where("not model").drop("model"), df.where("model").drop("model"), ["conv", "turn"]).collect())
    split = lambda s: distinct_stream(s.where("not model").drop("model"), s.where("model").drop("model"), ["conv", "turn"], "ts", "20 seconds")
    far = [("far", t, 0, "a", 0.5, "z", 0.0, "agent", at(t), False) for t in (500, 900)]
    for n in (1, 5):
        came = sorted(rows, key=lambda x: (x[1] + rng.choice([0, 3, 8]), rng.random()))
        batches = [came[i * len(came) // n : (i + 1) * len(came) // n] for i in range(n)] + [far[:1], far[1:]]
        got = run(spark, tmp_path, batches, schema, split, f"u{n}")
        assert sorted((r.conv, r.turn, r.seq, r.kind, r.confidence, r.evidence, r.t_end, r.speaker) for r in got if r.conv != "far") == want
    assert any(not x[9] for x in rows) and len(want) < len(rows)


def test_replay_of_a_call(spark):
    low, high = "low", "high"
    turns = [
        (0, "My name is Ann Lee", low, None), (1, " ", low, None), (2, "How much is it?", low, "ignored"), (3, "What is covered?", high, "Q. Approved response:  Room   rent is. " + "word " * 100), (4, "I am 45 years old, I live in Pune city", high, "x"),
        (5, "for my wife", high, None), (6, "call me back on Monday", high, None), (7, "diabetes and no more", high, "hit"), (8, "no health issue", high, "hit"), (9, "let me speak to someone", high, None), (10, "stop calling", high, None), (11, "so?", high, "an answer"),
    ]
    df = spark.createDataFrame([("c", t, x, "IN", tier, hit, ["r1", "r2", "r3", "r4"]) for t, x, tier, hit in turns], "call string, turn int, text string, market string, tier string, hit string, cited array<string>")
    got = {r.turn: r for r in dialogue.replay(df).collect()}
    loc = dialogue.LOCALES["IN"]
    assert got[0].reply == loc["ask"]["age"] and got[0].slots == {"name": "Ann Lee"} and got[0].status == "Incomplete" and got[0].citations == []
    assert got[1].reply == dialogue.NOT_HEARD and got[1].slots == {"name": "Ann Lee"} and got[1].route == "empty"
    assert got[2].reply == loc["unavailable"] and got[2].citations == []
    assert got[3].reply.startswith("Room rent is. word") and got[3].reply.endswith("word. " + loc["ask"]["age"]) and got[3].citations == ["r1", "r2", "r3"]
    assert got[4].reply == loc["ask"]["members"] and got[4].status == "Qualified" and got[4].plan == "Single" and got[4].slots["city"] == "Pune"
    assert got[5].plan == "Family" and got[5].reply == loc["ask"]["conditions"]
    assert got[6].action == "schedule_callback" and got[6].lead == "Qualified" and "(call me back on Monday)" in got[6].reply
    assert got[7].action == "schedule_callback" and got[8].slots["conditions"] == "none"  # a callback was asked for: it comes before the outcome
    assert (got[9].action, got[9].end_reason, got[9].lead) == ("escalate", "escalated", "Escalated") and got[8].end_reason is None
    assert (got[10].action, got[10].end_reason, got[10].reply) == ("mark_dnc", "dnc", loc["stopped"])
    assert got[11].end_reason == "dnc" and got[11].reply == "an answer"
    done = spark.createDataFrame([("d", 0, "I am 30 years old", "ID", None, None, None), ("d", 1, "ako si Budi", None, "high", None, None), ("d", 2, "tinggal di Bogor", "ID", "high", None, None), ("d", 3, "istri", "ID", "high", None, None), ("d", 4, "tidak ada", "ID", "medium", "z", None)], df.schema)
    got = {r.turn: r for r in dialogue.replay(done).collect()}
    assert got[4].action == "create_lead" and got[4].plan == "Loan" and got[4].reply.startswith("Based on what you have shared, preliminary status is Qualified for Loan. ") and got[4].citations == []
    assert got[1].reply == dialogue.LOCALES["IN"]["ask"]["city"]
    assert dialogue.replay(df.limit(0)).count() == 0
    assert T.SAID
