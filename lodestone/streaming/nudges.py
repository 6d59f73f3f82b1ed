"""Calls as streams: nudge control of signals, and of raw lines with clock and disclosure; one state per call, dropped when the call
has been silent for a while. Signals of rules and of a model as one stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions.text import words
from lodestone.operators.live import COOLDOWN, DISCLOSE_BY, DISCLOSED, PRIORITY, RULES, THRESHOLD, TTL, Controller, speaker_of, with_priority

OUTPUT = "call string, id string, kind string, confidence double, priority int, created_t double, expires_t double, evidence string, suppressed boolean, reason string"


class NudgeProcessor(StatefulProcessor):
    """Rows: call, kind, confidence, priority, t, seq, evidence. Within a batch a call's signals go in the order of t and seq;
    batches in the order of arrival."""

    def __init__(self, threshold: float = THRESHOLD, cooldown: float = COOLDOWN, ttl: float = TTL, idle_ms: int = 3_600_000):
        self.threshold, self.cooldown, self.ttl, self.idle_ms = threshold, cooldown, ttl, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("controller", "state string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.own.get()
        own = Controller(self.threshold, self.cooldown, json.loads(held[0]) if held else None)
        batch = pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")
        out = [own.consider(x.kind, x.confidence, x.evidence, x.t) for x in batch.itertuples(index=False)]
        self.own.update((json.dumps(own.state()),))
        yield pd.DataFrame(
            {
                "call": key[0], "id": [i for i, _ in out], "kind": batch["kind"].to_numpy(), "confidence": batch["confidence"].to_numpy(), "priority": batch["priority"].to_numpy(), "created_t": batch["t"].to_numpy(),
                "expires_t": batch["t"].to_numpy() + self.ttl, "evidence": batch["evidence"].to_numpy(), "suppressed": [r is not None for _, r in out], "reason": [r for _, r in out],
            }
        )

    def close(self) -> None:
        pass


def line_signals(lines: DataFrame, call: str, text: str, role: str, t_end: str, rules=RULES) -> DataFrame:
    """Rule signals of streamed lines, without state: call, kind, confidence, priority, t, seq, evidence."""
    who = speaker_of(F.col(role))
    own = [F.when((who == s) & F.col(text).rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"))) for s, kind, conf, p in rules]
    rows = lines.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(call).cast("string").alias("call"), F.col(t_end).cast("double").alias("t"), F.col(text).alias("evidence"), F.posexplode(F.array_compact(F.array(*own))).alias("seq", "s"))
    return with_priority(rows.select("call", "s.*", "t", "seq", "evidence"))


def stream_nudges(found: DataFrame, **options) -> DataFrame:
    """found: streamed signals. Needs the RocksDB state store (see rocksdb())."""
    return found.groupBy("call").transformWithStateInPandas(NudgeProcessor(**options), OUTPUT, "Append", "ProcessingTime")


LINE_OUTPUT = "call string, turn long, id string, kind string, confidence double, priority int, created_t double, expires_t double, evidence string, suppressed boolean, reason string"


class LineProcessor(StatefulProcessor):
    """Rows: call, turn, ts (milliseconds), agent, told, dur, found (numbers of the rules that the line meets), text.

    A call's lines are taken in the order of their turns, from `first` on. A line that comes before one that it follows is held
    until that one comes, or until the watermark is wait_ms past it: then the turns between are given up. A line whose turn has
    been passed is left out. The state goes, after what is still held, when the watermark is idle_ms past the call's last line.
    """

    def __init__(self, rules=RULES, threshold: float = THRESHOLD, cooldown: float = COOLDOWN, ttl: float = TTL, disclose_by: float = DISCLOSE_BY, wait_ms: int = 60_000, idle_ms: int = 3_600_000, first: int = 0):
        self.rules = [(kind, confidence) for _, kind, confidence, _ in rules]
        self.threshold, self.cooldown, self.ttl, self.disclose_by, self.wait_ms, self.idle_ms, self.first = threshold, cooldown, ttl, disclose_by, wait_ms, idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # next turn, seconds so far, whether the disclosure was heard, time of the last line
        self.clock = handle.getValueState("clock", "turn long, t double, told boolean, last long")
        self.control = handle.getValueState("control", "state string")
        self.held = handle.getMapState("held", "turn long", "ts long, agent boolean, told boolean, dur double, found string, text string")

    def _take(self, key, lines: list, clock: list, control: Controller) -> list:
        """lines: (turn, agent, told, dur, found, text), in order; clock and control go on."""
        out = []
        for turn, agent, told, dur, found, text in lines:
            clock[0], clock[1] = turn + 1, round(clock[1] + dur, 6)
            clock[2] = clock[2] or (agent and told)
            signals = [(*self.rules[i], text) for i in found]
            if agent and not clock[2] and clock[1] >= self.disclose_by:
                signals.append(("compliance_gap", 0.9, "No disclosure heard."))
            for kind, confidence, evidence in signals:
                name, reason = control.consider(kind, confidence, evidence, clock[1])
                out.append((key[0], turn, name, kind, confidence, PRIORITY.get(kind, 10), clock[1], clock[1] + self.ttl, evidence, reason is not None, reason))
        return out

    def _load(self) -> tuple[list, Controller]:
        clock, state = self.clock.get(), self.control.get()
        return list(clock) if clock else [self.first, 0.0, False, 0], Controller(self.threshold, self.cooldown, json.loads(state[0]) if state else None)

    def _store(self, clock: list, control: Controller) -> None:
        self.clock.update(tuple(clock))
        self.control.update((json.dumps(control.state()),))

    def _release(self, held: dict, clock: list, most: int = -1) -> list:
        """The held lines that follow the last one; up to the turn `most` also where turns between are missing. Held no more."""
        out, following = [], clock[0]
        for turn in sorted(held):
            if turn != following and turn > most:
                break
            _, agent, told, dur, found, text = held.pop(turn)
            self.held.removeKey((turn,))
            out.append((turn, agent, told, dur, json.loads(found), text))
            following = turn + 1
        return out

    def _frame(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE_OUTPUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        clock, control = self._load()
        held = {int(k[0]): tuple(v) for k, v in self.held.iterator()}
        for b in rows:
            for x in b.itertuples(index=False):
                turn, ts = int(x.turn), int(x.ts)
                if turn >= clock[0] and turn not in held:
                    line = (ts, bool(x.agent), bool(x.told), float(x.dur), json.dumps([int(i) for i in x.found]), x.text)
                    held[turn] = line
                    self.held.updateValue((turn,), line)
                clock[3] = max(clock[3], ts)
        out = self._take(key, self._release(held, clock), clock, control)
        for at in {v[0] + self.wait_ms for v in held.values()} | {clock[3] + self.idle_ms}:
            self.handle.registerTimer(at)
        self._store(clock, control)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        clock, control = self._load()
        held = {int(k[0]): tuple(v) for k, v in self.held.iterator()}
        over = now >= clock[3] + self.idle_ms
        due = [turn for turn, v in held.items() if over or v[0] + self.wait_ms <= now]
        out = self._take(key, self._release(held, clock, max(due)), clock, control) if due else []
        if over:
            self.clock.clear(), self.control.clear(), self.held.clear()
        elif out:
            self._store(clock, control)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def line_nudges(lines: DataFrame, call: str, turn: str, text: str, role: str, ts: str, late: str = "1 minute", rules=RULES, disclosed: str = DISCLOSED, per_word: float = 0.38, least: float = 2.0, most: float = 12.0, **options) -> DataFrame:
    """Nudges of streamed raw lines, as live.signals() and live.nudges() give them for whole calls, missing disclosure included. ts:
    the line's event time. Lines may come out of order up to `late`, and wait for those before them as LineProcessor says. The
    rules run on columns; the state of a call is a few numbers, its last nudges, and the lines that wait. Null texts are empty, a
    null turn is left out. Needs the RocksDB state store."""
    who, said = speaker_of(F.col(role)), F.coalesce(F.col(text), F.lit(""))
    met = F.array_compact(F.array(*(F.when((who == s) & said.rlike(p), F.lit(i)) for i, (s, _, _, p) in enumerate(rules))))
    dur = F.round(F.least(F.lit(most), F.greatest(F.lit(least), F.size(words(said)) * F.lit(per_word))), 6)
    told = (who == "agent") & said.rlike(disclosed)
    rows = lines.withWatermark(ts, late).where(F.col(turn).isNotNull()).select(F.col(call).cast("string").alias("call"), F.col(ts).alias("at"), F.col(turn).cast("long").alias("turn"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ts"), (who == "agent").alias("agent"), told.alias("told"), dur.alias("dur"), met.alias("found"), said.alias("text"))
    return rows.groupBy("call").transformWithStateInPandas(LineProcessor(rules, **options), LINE_OUTPUT, "Append", "EventTime")


def distinct_stream(rule: DataFrame, model: DataFrame, keys: list[str], ts: str, late: str = "1 minute") -> DataFrame:
    """live.distinct_signals() of two streams: of signals with the same keys, time, kind and first 80 characters of evidence one is
    given, a rule's before a model's, whichever came first. ts: the line's event time, the same for all its signals. What a signal
    is compared to may come up to `late` after it, so it is given when the watermark has passed it; later ones are left out.
    (Dropping duplicates as they come would keep the first to arrive.)"""
    both = rule.withColumn("_from", F.lit(0)).unionByName(model.withColumn("_from", F.lit(1))).withWatermark(ts, late)
    first = F.struct("_from", *[c for c in ("seq",) if c in rule.columns])
    rest = [c for c in rule.columns if c not in (ts, *keys, "kind")]
    return both.groupBy(ts, *keys, "kind", F.substring("evidence", 1, 80).alias("_e")).agg(F.min_by(F.struct(*rest), first).alias("x")).select(ts, *keys, "kind", *(F.col(f"x.{c}").alias(c) for c in rest)).select(rule.columns)


def rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def windowed_counts(lines: DataFrame, ts: str, kind: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Signals by kind and tumbling window, late ones up to a bound."""
    return lines.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")
