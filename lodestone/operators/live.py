"""Live calls: clock, rule signals, disclosure, nudge control, latency, as batch operators over whole calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.store import cut
from lodestone.functions.text import words

THRESHOLD, COOLDOWN, TTL, DUPLICATE, RECENT, DISCLOSE_BY = 0.65, 45.0, 60.0, 0.6, 6, 8.0
# Priority of a signal's kind; others have 10.
PRIORITY = {"compliance_gap": 100, "rising_frustration": 90, "payment_difficulty": 70, "missed_cross_sell": 60, "callback_need": 50, "buying_signal": 40, "topic_shift": 20}
# Fixed values: (speaker, kind, confidence, pattern).
RULES = [
    ("customer", "missed_cross_sell", 0.82, r"(?i)\b(second|another|other)\s+(car|vehicle|bike|motor|mobil)\b|\b(wife'?s? car|husband'?s? car|mobil (?:isteri|istri|suami)|motor dinas)\b|\b(parents?|father|mother|asawa|anak|spouse|kids?)\b.{0,40}\b(cover|policy|insured)\b|\bcritical illness\b"),
    ("customer", "buying_signal", 0.78, r"(?i)\b(how much|magkano|berapa|premium|quote|send (me )?the (summary|quote)|I'll take|let's proceed|sige po)\b"),
    ("customer", "rising_frustration", 0.88, r"(?i)\b(this is ridiculous|useless|stupid bot|waste (of )?time|already told you|hindi niyo ba maintindihan|kesal|capek banget)\b|\b(annoyed|frustrated|angry|fed up|irritat)\b|!{2,}"),
    ("customer", "payment_difficulty", 0.80, r"(?i)\b(cannot pay|can't pay|no money|gaji belum|dendanya|mahal banget|too expensive|hindi afford)\b"),
    ("customer", "callback_need", 0.75, r"(?i)\b(call me back|callback|tawag(?:an)? (?:mo|ninyo)|hubungi (?:saya|aku)|not a good time)\b"),
    ("agent", "compliance_gap", 0.93, r"(?i)\b(guaranteed|100%\s*covered|no exclusions|approved|sure claim|no questions asked)\b|\b(day one|from day 1).{0,20}(pre-existing|PED)\b"),
]
DISCLOSED = r"(?i)this call is being recorded|nire-record|panggilan ini direkam|subject matter of solicitation"


def speaker_of(role: Column) -> Column:
    return F.when(F.lower(role).isin("customer", "cust", "user"), "customer").otherwise("agent")


def with_clock(turns: DataFrame, call: str, turn: str, text: str, per_word: float = 0.38, least: float = 2.0, most: float = 12.0) -> DataFrame:
    """Adds t_start and t_end: each turn takes per_word seconds a word, within bounds, one after the other."""
    dur = F.least(F.lit(most), F.greatest(F.lit(least), F.size(words(F.coalesce(F.col(text), F.lit("")))) * F.lit(per_word)))
    timed = turns.withColumn("_dur", F.round(dur, 6))
    end = F.round(F.sum("_dur").over(W.partitionBy(call).orderBy(turn).rowsBetween(W.unboundedPreceding, 0)), 6)
    return timed.withColumn("t_end", end).withColumn("t_start", F.round(F.col("t_end") - F.col("_dur"), 6)).drop("_dur")


def scripted(spark: SparkSession, scenarios: dict[str, list[tuple[str, float, str]]]) -> DataFrame:
    """scenarios: name to (speaker, seconds, text) in turn. (call, turn, speaker, text, t_start, t_end), one turn after another."""
    rows = [(name, i, s, t, float(d)) for name, turns in scenarios.items() for i, (s, d, t) in enumerate(turns)]
    said = spark.createDataFrame(rows, "call string, turn int, speaker string, text string, seconds double")
    end = F.sum("seconds").over(W.partitionBy("call").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return said.withColumn("t_end", end).withColumn("t_start", F.col("t_end") - F.col("seconds")).drop("seconds")


def outcomes(shown: DataFrame, expected: DataFrame) -> DataFrame:
    """shown: nudges; expected: (call, kinds). (call, kinds, emitted, passed): all expected kinds were emitted, and none at all
    where none is expected."""
    got = shown.where(~F.col("suppressed")).groupBy("call").agg(F.array_sort(F.collect_set("kind")).alias("emitted"))
    out = expected.join(got, "call", "left").withColumn("emitted", F.coalesce("emitted", F.array().cast("array<string>")))
    missed = F.size(F.array_except("kinds", "emitted"))
    return out.withColumn("passed", F.when(F.size("kinds") == 0, F.size("emitted") == 0).otherwise(missed == 0))


def signals(lines: DataFrame, call: str, order: str, text: str, rules=RULES, disclosed: str = DISCLOSED, disclose_by: float = DISCLOSE_BY) -> DataFrame:
    """lines: call, order, text, speaker, t_end. (call, order, seq, kind, confidence, evidence, t_end, speaker), one row a signal,
    in the order in which they are considered: the rules of the line, then a missing disclosure."""
    said = (F.col("speaker") == "agent") & F.coalesce(F.col(text), F.lit("")).rlike(disclosed)
    w = W.partitionBy(call).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    flagged = lines.withColumn("_disclosed", F.bool_or(said).over(w))
    signal = lambda when, kind, conf, evidence: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"), evidence.alias("evidence")))
    own = [signal((F.col("speaker") == s) & F.col(text).rlike(p), kind, conf, F.col(text)) for s, kind, conf, p in rules]
    missing = signal((F.col("speaker") == "agent") & ~F.col("_disclosed") & (F.col("t_end") >= disclose_by), "compliance_gap", 0.9, F.lit("No disclosure heard."))
    rows = flagged.select(call, order, "speaker", "t_end", F.posexplode(F.array_compact(F.array(*own, missing))).alias("seq", "s"))
    return rows.select(call, order, "seq", "s.*", "t_end", "speaker")


def distinct_signals(rule: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rule signals and model signals; of those with the same keys, kind and first 80 characters of evidence the rule's stays."""
    both = rule.withColumn("_from", F.lit(0)).unionByName(model.withColumn("_from", F.lit(1)))
    return both.groupBy(*keys, "kind", F.substring("evidence", 1, 80).alias("_e")).agg(F.min_by(F.struct(*rule.columns), F.struct("_from", *[c for c in ("seq",) if c in rule.columns])).alias("x")).select("x.*")


def with_priority(rows: DataFrame, table: dict[str, int] = PRIORITY) -> DataFrame:
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return rows.withColumn("priority", F.coalesce(known[F.col("kind")], F.lit(10)))


def cooldown(events: DataFrame, keys: list[str], t: str, seconds: float, tie: str) -> DataFrame:
    """Adds `emitted`: the first of each key, then each that comes at least `seconds` after the last emitted one.

    Sorted within keys by Spark and folded row by row, so a task holds the last time of a key and not its rows.
    """
    rows = events.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, t, tie)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            out = []
            for x in zip(b.column(t).to_pylist(), *(b.column(k).to_pylist() for k in keys)):
                if x[1:] != now:
                    now, last, first = x[1:], None, True
                else:
                    first = last is None
                out.append(first or (x[0] is not None and x[0] - last >= seconds))
                last = x[0] if out[-1] else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "emitted"])

    return rows.mapInArrow(fold, T.StructType([*events.schema.fields, T.StructField("emitted", T.BooleanType(), False)]))


def overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class Controller:
    """The state of one call: threshold, cooldown, duplicate evidence, in this order. Also the streaming operator's."""

    def __init__(self, threshold: float = THRESHOLD, cooldown: float = COOLDOWN, state: dict | None = None):
        self.threshold, self.cooldown = threshold, cooldown
        s = state or {"n": 0, "last": {}, "recent": []}
        self.n, self.last, self.recent = s["n"], dict(s["last"]), [tuple(x) for x in s["recent"]]

    def consider(self, kind: str, confidence: float, evidence: str, t: float) -> tuple[str, str | None]:
        """(id, why it is suppressed); considered signals count, suppressed ones too."""
        self.n += 1
        name = f"N{self.n:03d}"
        if confidence < self.threshold:
            return name, "below_threshold"
        if kind in self.last and t - self.last[kind] < self.cooldown:
            return name, "cooldown"
        found = set((evidence or "").lower().split())
        if any(k == kind and overlap(set(w), found) > DUPLICATE for k, w in self.recent):
            return name, "duplicate_evidence"
        self.last[kind] = t
        self.recent = [*self.recent, (kind, sorted(found))][-RECENT:]
        return name, None

    def state(self) -> dict:
        return {"n": self.n, "last": self.last, "recent": [list(x) for x in self.recent]}


def nudges(found: DataFrame, call: str, order: list[str], threshold: float = THRESHOLD, cooldown: float = COOLDOWN, ttl: float = TTL) -> DataFrame:
    """found: signals. (call, id, kind, confidence, priority, created_t, expires_t, evidence, suppressed, reason).

    Sorted within calls by Spark and folded row by row, so a task holds a call's state and not its rows.
    """
    rows = with_priority(found).select(F.col(call).cast("string").alias("call"), "kind", "confidence", "priority", F.col("t_end").alias("t"), "evidence", F.struct(*order).alias("o"))
    rows = rows.repartition(F.col("call")).sortWithinPartitions("call", "o").drop("o")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                if x.call != now:
                    now, own = x.call, Controller(threshold, cooldown)
                out.append(own.consider(x.kind, x.confidence, x.evidence, x.t))
            b = b.assign(id=[i for i, _ in out], reason=[r for _, r in out])
            b["suppressed"], b["created_t"], b["expires_t"] = b["reason"].notna(), b["t"], b["t"] + ttl
            yield b[["call", "id", "kind", "confidence", "priority", "created_t", "expires_t", "evidence", "suppressed", "reason"]]

    return rows.mapInPandas(fold, "call string, id string, kind string, confidence double, priority int, created_t double, expires_t double, evidence string, suppressed boolean, reason string")


def active(emitted: DataFrame, now: float) -> DataFrame:
    return emitted.where(~F.col("suppressed") & (F.col("expires_t") >= now))


def controller_stats(rows: DataFrame, kind: str, suppressed: Column, reason: Column) -> DataFrame:
    """(level, kind, reason, n): totals, by kind and by reason, of emitted and suppressed, in one pass over the rows."""
    base = rows.select(F.col(kind).alias("kind"), suppressed.alias("suppressed"), reason.alias("reason"))
    g = base.groupingSets([["suppressed"], ["suppressed", "kind"], ["suppressed", "reason"]], "suppressed", "kind", "reason").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "kind").otherwise("reason")
    return g.select(level.alias("level"), "suppressed", "kind", "reason", "n").where("level <> 'reason' OR suppressed")


def quantile_values(samples: DataFrame, by: str, value: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """(by, n, share, x): the value at place round(share (n - 1)) of each group's sorted values, halves to even. Exact, without a
    sort or a window over a group.

    Each round cuts the range that holds a place into bins of equal width, counts the values in each, and goes on with the bin that
    holds it, until its values are all equal. So a round is one scan and a sum in each task first, however many values a group has.
    Null values are left out; -0.0 counts as 0.0.
    """
    rows = samples.select(F.col(by).alias("g"), (F.col(value).cast("double") + 0.0).alias("v")).where("v IS NOT NULL")
    rows = cut(rows)
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.bround(F.lit(float(s)) * (F.col("n") - 1)).cast("long").alias("at")) for s in shares)))
    # lo and hi are values of the group; `at` is the place among those from lo to hi.
    open_ = cut(ends.select("g", "n", place.alias("p"), "lo", "hi").select("g", "n", "p.share", "p.at", "lo", "hi"))
    done = None
    while True:
        found = open_.where("lo = hi").select("g", "n", "share", F.col("lo").alias("x"))
        done = found if done is None else done.union(found)
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            return done.select(F.col("g").alias(by), "n", "share", "x")
        left = rows.join(open_.withColumnRenamed("g", "g_"), F.col("g").eqNullSafe(F.col("g_")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # Half the range first, so that it can't overflow; the last value is in the last bin.
        step = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)
        counts = left.groupBy("g_", "n", "share", "at", F.least(step, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("m").over(W.partitionBy("g_", "share").orderBy("bin")) - F.col("m")
        at = counts.withColumn("before", before).where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("m")))
        open_ = cut(at.select(F.col("g_").alias("g"), "n", "share", (F.col("at") - F.col("before")).alias("at"), "lo", "hi"))


def latency_summary(samples: DataFrame, by: str, ms: str) -> DataFrame:
    """(by, count, p50_ms, p95_ms, max_ms, mean_ms), to a tenth. Nearest rank: place round(p (n - 1)), halves to even. Groups without
    a value are left out."""
    places = quantile_values(samples, by, ms, [0.5, 0.95]).withColumnRenamed(by, "_g")
    at = lambda s: F.bround(F.max(F.when(F.col("share") == s, F.col("x"))), 1)
    ranks = cut(places.groupBy("_g").agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms")))
    sums = samples.where(F.col(ms).isNotNull()).groupBy(by).agg(F.count("*").alias("count"), F.bround(F.max(ms), 1).alias("max_ms"), F.bround(F.avg(ms), 1).alias("mean_ms"))
    return sums.join(ranks, F.col(by).eqNullSafe(F.col("_g"))).select(by, "count", "p50_ms", "p95_ms", "max_ms", "mean_ms")


def precision_proxy(results: DataFrame, noisy: Column, emitted: Column) -> DataFrame:
    """1 - noisy emitted / emitted, three places."""
    return results.agg(F.bround(1 - F.sum(F.when(noisy, emitted).otherwise(0)) / F.greatest(F.sum(emitted), F.lit(1)), 3).alias("precision"))
