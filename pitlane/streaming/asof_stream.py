"""As-of matching and lap telemetry on streams, without a look-back limit (ST1, ST3).

``asof_stream`` gives every question row the latest answer row at or before its time. It is the streaming form of the
two-level batch join: questions and answers meet in a stateful operator per (group, time slice), which settles what
its own slice can settle, and a second one per group keeps a single answer, the last one of all closed slices, for the questions
that come before the first answer of their slice. So a group with most of all rows spreads over its slices, and the state is the
rows that the watermark has not passed and one answer a slice and group, however old that answer is.

A question is answered once the watermark has passed it: from then on no earlier answer can arrive. Timers fire at the
earliest open question of a slice and at the end of the slice; a closed slice leaves no state. Both operators keep their state in
the checkpoint, so a restarted query goes on where the last one stopped.

``lap_telemetry`` chains three operators: samples ask for their lap start, each lap start asks for the one before it,
and a lap's sums are given out when the next start has been passed by the watermark. The third one holds the open laps of
``LAP_BLOCK`` lap numbers of a car side by side, so a trigger costs a call a block, not a lap. Laps that never see a
next start are forgotten ``keep_hours`` after their start.

``latest_weather_stream`` has a look-back, so it needs no second operator: a reading is in every slice that its look-back reaches.
A lap with a reading comes out once it is below the watermark, one without once the look-back after it is, too.

Rows are kept in blocks: a state entry is an Arrow stream of the rows that came together.

Rows later than the watermark are dropped, as in every streaming query. Questions without any earlier answer come
out with nulls. Rows without a time are ignored. Equal answer times: the highest ``tie`` wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitlane import constants as K
from pitlane.session import prepare

SLICE_US = 3_600_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ANSWER = T.StructType([T.StructField("us", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("a", T.StringType())])
_BLOCK = T.StructType([T.StructField("rows", T.BinaryType())])
ANSWER, OPEN, SETTLED = 0, 1, 2  # what a row between the two operators is


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streaming state is kept by RocksDB, as these operators need."""
    own = prepare(spark.newSession())
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"):
        if spark.conf.get(k, None) is not None:
            own.conf.set(k, spark.conf.get(k))
    return own


def _block(columns: dict[str, np.ndarray]) -> tuple[bytes]:
    """Rows as a state entry."""
    table = pa.table({c: pa.array(v, from_pandas=True) for c, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _rows(state: Any) -> dict[str, np.ndarray] | None:
    """The rows of all entries of a list state."""
    if not state.exists():
        return None
    table = pa.concat_tables([pa.ipc.open_stream(bytes(x[0])).read_all() for x in state.get()])
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _taken(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in columns.items()}


def in_order(answers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Answers by time, tie and payload."""
    us, tie = answers["us"], answers["tie"]
    order = np.lexsort((tie, us))
    if (np.diff(us[order]) + np.abs(np.diff(tie[order])) == 0).any():
        order = np.lexsort((np.unique(answers["a"], return_inverse=True)[1], tie, us))
    return _taken(answers, order)


def latest(answers: dict[str, np.ndarray] | None, times: np.ndarray) -> np.ndarray:
    """Payload of the last of the sorted ``answers`` (us, tie, a) at or before each time, None without one."""
    if answers is None:
        return np.full(len(times), None, object)
    at = np.searchsorted(answers["us"], times, side="right")
    return np.concatenate([np.array([None], object), answers["a"]])[at]


def _columns(df: pd.DataFrame, names: list[str], rows: np.ndarray) -> dict[str, np.ndarray]:
    kinds = {"q": object, "a": object, "has": bool}
    return {c: df[c].to_numpy(kinds.get(c, np.int64))[rows] for c in names}


ANSWERS, QUESTIONS = ["us", "tie", "a"], ["us", "q"]


class SliceAsof(StatefulProcessor):
    """Answers the questions of one (group, slice) from its own slice once the watermark has passed them."""

    def __init__(self, by: list[str], slice_us: int):
        self.by, self.slice_us = by, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getListState("answer_blocks", _BLOCK)
        self.questions = handle.getListState("question_blocks", _BLOCK)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = (key[-1] + 1) * self.slice_us - 1
        for df in rows:
            is_answer = df["kind"].to_numpy() == ANSWER
            if is_answer.any():
                self.answers.appendValue(_block(_columns(df, ANSWERS, is_answer)))
            if not is_answer.all():
                asked = _columns(df, QUESTIONS, ~is_answer)
                self.questions.appendValue(_block(asked))
                first = min(first, int(asked["us"].min()))
        self.handle.registerTimer(_fires_after(first))  # the end of the slice, if nothing is asked before
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        limit, end = passed * 1000, (key[-1] + 1) * self.slice_us
        asked, answers = _rows(self.questions), _rows(self.answers)
        if asked is None and answers is None:  # closed by an earlier timer
            yield pd.DataFrame()
            return
        answers = None if answers is None else in_order(answers)
        asked = {"us": np.empty(0, np.int64), "q": np.empty(0, object)} if asked is None else asked
        is_due = asked["us"] <= limit
        due = _taken(asked, is_due)
        found = latest(answers, due["us"])
        left_open = np.array([x is None for x in found], bool)
        out = {"part": np.where(left_open, -1, key[-1]), "kind": np.where(left_open, OPEN, SETTLED), "us": due["us"], "tie": np.zeros(len(found), np.int64), "q": due["q"], "a": found}
        if end - 1 <= limit:
            if answers is not None:
                last = {"part": -1, "kind": ANSWER, "us": answers["us"][-1], "tie": answers["tie"][-1], "q": None, "a": answers["a"][-1]}
                out = {c: np.append(v, last[c]) for c, v in out.items()}
            self.answers.clear()
            self.questions.clear()
        else:
            self.handle.registerTimer(_fires_after(end - 1))
            if len(found):
                rest = _taken(asked, ~is_due)
                self.questions.clear()
                if len(rest["us"]):
                    self.questions.put([_block(rest)])
                    self.handle.registerTimer(_fires_after(int(rest["us"].min())))
                gone = 0 if answers is None else int((answers["us"] <= limit).sum()) - 1  # all but the last one passed are never asked for again
                if gone > 0:
                    self.answers.put([_block(_taken(answers, slice(gone, None)))])
        yield _with_key(out, self.by, key, passed) if len(out["us"]) else pd.DataFrame()

    def close(self) -> None:
        pass


class GroupAsof(StatefulProcessor):
    """Keeps the last answer of a group's closed slices for the questions that their own slice left open."""

    def __init__(self, by: list[str]):
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _ANSWER)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] >= 0:  # settled already; dealt by slice
            yield from (df[[*self.by, "us", "q", "a", "et"]] for df in rows)
            return
        df = pd.concat(list(rows), ignore_index=True)
        is_answer = df["kind"].to_numpy() == ANSWER
        answers = _columns(df, ANSWERS, is_answer)
        if self.last.exists():
            answers = {c: np.append(v, x) for (c, v), x in zip(answers.items(), self.last.get(), strict=True)}
        answers = in_order(answers)
        if len(answers["us"]):
            self.last.update((int(answers["us"][-1]), int(answers["tie"][-1]), answers["a"][-1]))
        still = df[~is_answer]
        yield still.assign(a=latest(answers, still["us"].to_numpy(np.int64)))[[*self.by, "us", "q", "a", "et"]]

    def close(self) -> None:
        pass


def _fires_after(us: int) -> int:
    """The timer (ms) that has expired once the watermark has passed ``us``."""
    return -(-us // 1000)


def _with_key(out: dict[str, np.ndarray], by: list[str], key: Any, passed: int) -> pd.DataFrame:
    """The rows with their group and the time at which they come out, just past the watermark."""
    n = len(out["us"])
    groups = {c: [v] * n for c, v in zip(by, key, strict=False)}
    return pd.DataFrame({**groups, **out, "et": np.full(n, pd.Timestamp((passed + 1) * 1_000_000).to_datetime64())})


def asof_stream(questions: DataFrame, answers: DataFrame, by: list[str], time: str, delay: str = "3 minutes", slice_us: int = SLICE_US, tie: str | None = None) -> DataFrame:
    """Questions with the columns of the latest answer at or before ``time`` (a timestamp in both), per ``by``.

    Append mode; the watermark is the slower input's latest time minus ``delay``. Returns ``by``, ``us`` (the question's time), the
    questions' other columns, the answers' other columns and ``et`` (when the row came out, for operators that follow).
    """
    q_cols = [c for c in questions.columns if c not in (*by, time)]
    a_cols = [c for c in answers.columns if c not in (*by, time)]
    us = F.unix_micros(time)
    common = [*by, time, F.floor(us / F.lit(slice_us)).alias("slice"), us.alias("us")]
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    q = questions.where(F.col(time).isNotNull()).withWatermark(time, delay).select(*common, F.lit(OPEN).alias("kind"), zero.alias("tie"), F.to_json(F.struct(*q_cols)).alias("q"), none.alias("a"))
    rank = F.col(tie).cast("long") if tie else zero
    a = answers.where(F.col(time).isNotNull()).withWatermark(time, delay).select(*common, F.lit(ANSWER).alias("kind"), rank.alias("tie"), none.alias("q"), F.to_json(F.struct(*a_cols)).alias("a"))
    keys = ", ".join(f"{c} {questions.schema[c].dataType.simpleString()}" for c in by)
    slices = q.unionByName(a).groupBy(*by, "slice").transformWithStateInPandas(
        SliceAsof(by, slice_us), f"{keys}, part long, kind int, us long, tie long, q string, a string, et timestamp", "Append", "EventTime", eventTimeColumnName="et")
    out = slices.groupBy(*by, "part").transformWithStateInPandas(
        GroupAsof(by), f"{keys}, us long, q string, a string, et timestamp", "Append", "EventTime", eventTimeColumnName="et")
    parsed = lambda df, cols, c: F.from_json(c, T.StructType([df.schema[x] for x in cols])).alias(f"__{c}")
    return out.select(*by, "us", parsed(questions, q_cols, "q"), parsed(answers, a_cols, "a"), "et").select(*by, "us", "__q.*", "__a.*", "et")


# --- ST3 ----------------------------------------------------------------------------

def weather_asof_stream(laps: DataFrame, weather: DataFrame, delay: str = "3 minutes", slice_us: int = SLICE_US) -> DataFrame:
    """ST3: each lap (event_id, Year, RoundNumber, ts) with the latest weather at or before it (Year, RoundNumber, ts, w_id and values)."""
    out = asof_stream(laps, weather, ["Year", "RoundNumber"], "ts", delay, slice_us, tie="w_id")
    return out.withColumnRenamed("us", "lap_us").drop("w_id", "et")


class SliceLatest(StatefulProcessor):
    """The latest reading within a look-back for the laps of one (race, slice), which also holds the readings that reach into it."""

    def __init__(self, by: list[str], slice_us: int, look_us: int):
        self.by, self.slice_us, self.look_us = by, slice_us, look_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("reading_blocks", _BLOCK)
        self.laps = handle.getListState("lap_blocks", _BLOCK)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = (key[-1] + 1) * self.slice_us - 1
        for df in rows:
            is_reading = df["kind"].to_numpy() == ANSWER
            if is_reading.any():
                self.readings.appendValue(_block(_columns(df, ANSWERS, is_reading)))
            if not is_reading.all():
                laps = _columns(df, LAPS, ~is_reading)
                self.laps.appendValue(_block(laps))
                first = min(first, int(laps["us"].min()))
        self.handle.registerTimer(_fires_beyond(first))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        laps, readings = _rows(self.laps), _rows(self.readings)
        out = pd.DataFrame()
        if laps is not None:
            readings_there = readings is not None
            times, found = laps["us"], np.zeros(len(laps["us"]), bool)
            if readings_there:
                readings = in_order(readings)
                at = np.searchsorted(readings["us"], times, side="right") - 1
                found = (at >= 0) & (times - readings["us"][at] <= self.look_us)
            is_due = np.where(found, times, times + self.look_us) < passed
            due = np.flatnonzero(is_due)
            order = due[np.lexsort((laps["has"][due], laps["id"][due], times[due]))]
            got = _taken(laps, order)
            again = np.zeros(len(order), bool)  # a lap that is there twice comes out once
            again[1:] = np.logical_and.reduce([got[c][1:] == got[c][:-1] for c in LAPS])
            order = order[~again]
            a = np.full(len(order), None, object)
            if readings_there:
                a = np.where(found[order], readings["a"][at[order]], None)
            out = pd.DataFrame({**{c: [v] * len(order) for c, v in zip(self.by, key, strict=False)}, **_taken(laps, order), "a": a})
            rest = _taken(laps, ~is_due)
            self.laps.clear()
            if len(rest["us"]):
                self.laps.put([_block(rest)])
                ahead = np.where(rest["us"] < passed, rest["us"] + self.look_us, rest["us"])
                self.handle.registerTimer(_fires_beyond(int(ahead.min())))
        end = (key[-1] + 1) * self.slice_us
        if end <= passed:
            self.readings.clear()
        else:
            self.handle.registerTimer(_fires_beyond(end - 1))
            if readings is not None and (old := readings["us"] < passed - self.look_us).any():
                self.readings.clear()
                if not old.all():
                    self.readings.put([_block(_taken(readings, ~old))])
        if not len(out):
            yield pd.DataFrame()
        for lo in range(0, len(out), 100_000):
            yield out.iloc[lo:lo + 100_000]

    def close(self) -> None:
        pass


LAPS = ["us", "id", "has"]


def _fires_beyond(us: int) -> int:
    """The timer (ms) that has expired once ``us`` is below the watermark."""
    return us // 1000 + 1


def latest_weather_stream(laps: DataFrame, weather: DataFrame, look_us: int, delay: str = "3 minutes", slice_us: int = SLICE_US) -> DataFrame:
    """ST3 with a look-back: laps (event_id, Year, RoundNumber, lap_ts), weather (wYear, wRound, w_ts and values).

    A reading is dealt to its slice and to those that its look-back reaches, so a slice settles its laps alone: a lookup in sorted readings
    each, whatever the number of readings within the look-back. Equal times: the highest reading as text.
    """
    race = ["Year", "RoundNumber"]  # a lap with a null in it has no reading; state keys hold no nulls
    by = [*race, *(f"no_{c}" for c in race)]
    keyed = [*(F.coalesce(c, F.lit(0)).cast(laps.schema[c].dataType).alias(c) for c in race), *(F.col(c).isNull().alias(f"no_{c}") for c in race)]
    values = [c for c in weather.columns if c not in ("wYear", "wRound", "w_ts")]
    us, slice_of = F.unix_micros("ts"), lambda t: F.floor(t / F.lit(slice_us))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    asked = laps.select(*keyed, F.col("lap_ts").alias("ts"), "event_id").where("ts is not null").withWatermark("ts", delay)
    asked = asked.select(*by, "ts", slice_of(us).alias("slice"), us.alias("us"), F.lit(OPEN).alias("kind"), zero.alias("tie"),
                         F.coalesce("event_id", zero).alias("id"), F.col("event_id").isNotNull().alias("has"), none.alias("a"))
    read = weather.select(F.col("wYear").alias("Year"), F.col("wRound").alias("RoundNumber"), F.col("w_ts").alias("ts"), F.to_json(F.struct(*values)).alias("a"))
    read = read.where("ts is not null and Year is not null and RoundNumber is not null").withWatermark("ts", delay)
    read = read.select(*keyed, "ts", F.explode(F.sequence(slice_of(us), slice_of(us + F.lit(look_us)))).alias("slice"), us.alias("us"), F.lit(ANSWER).alias("kind"),
                       zero.alias("tie"), zero.alias("id"), F.lit(False).alias("has"), "a")
    keys = ", ".join([*(f"{c} {laps.schema[c].dataType.simpleString()}" for c in race), *(f"no_{c} boolean" for c in race)])
    out = asked.unionByName(read).groupBy(*by, "slice").transformWithStateInPandas(
        SliceLatest(by, slice_us, look_us), f"{keys}, us long, id long, has boolean, a string", "Append", "EventTime")
    parsed = F.from_json("a", T.StructType([weather.schema[c] for c in values])).alias("w")
    return out.select(F.when(F.col("has"), F.col("id")).alias("event_id"), *(F.when(~F.col(f"no_{c}"), F.col(c)).alias(c) for c in race), F.col("us").alias("lap_us"), parsed).select("event_id", *race, "lap_us", "w.*")


# --- ST1 ----------------------------------------------------------------------------

CHANNELS = ["Speed", "Throttle", "Brake", "DRS", "RPM", "nGear"]
LAP_TELEMETRY = ["avg_speed_kph", "max_speed_kph", "avg_throttle_pct", "full_throttle_pct", "avg_brake", "braking_pct", "drs_active_pct", "avg_rpm", "avg_gear"]
#: Lap numbers of a car whose open laps share a state entry.
LAP_BLOCK = 256
_MEANS = ["Speed", "Throttle", "Brake", "RPM", "nGear"]


def _added(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of equal laps added up."""
    laps, at = np.unique(rows["lap"], return_inverse=True)
    out = {c: np.bincount(at, v, len(laps)) for c, v in rows.items() if c not in ("lap", "forget", "max_Speed")}
    forget, most = np.full(len(laps), np.iinfo(np.int64).max), np.full(len(laps), np.nan)
    np.minimum.at(forget, at, rows["forget"])
    np.fmax.at(most, at, rows["max_Speed"])
    return {"lap": laps, "forget": forget, "max_Speed": most, **out}


class LapSums(StatefulProcessor):
    """Sums of the samples of a block of one car's laps; a lap is given out when it has ended."""

    def __init__(self, by: list[str], min_samples: int, keep_hours: float, drs_open_min: int):
        self.by, self.min_samples, self.keep_ms, self.drs = by, min_samples, int(keep_hours * 3_600_000), drs_open_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open_laps", _BLOCK)

    def _sums(self, df: pd.DataFrame) -> dict[str, np.ndarray]:
        """One row a lap: its sums, whether it has ended, and when it is forgotten otherwise."""
        ends = df["ends"].to_numpy(bool)
        v = {c: np.where(ends, np.nan, df[c].to_numpy(np.float64)) for c in CHANNELS}
        d = {"lap": df["LapNumber"].to_numpy(), "ended": ends.astype(float), "forget": (df["lap_start_us"].to_numpy(np.int64) // 1000 + self.keep_ms), "max_Speed": v["Speed"], "n": ~ends}
        for c in _MEANS:
            d[f"sum_{c}"], d[f"cnt_{c}"] = np.nan_to_num(v[c]), ~np.isnan(v[c])
        d["full"], d["braking"], d["drs"] = v["Throttle"] >= K.FULL_THROTTLE_PCT, v["Brake"] > 0, v["DRS"] >= self.drs
        return _added(d)

    def _keep(self, laps: dict[str, np.ndarray]) -> None:
        if not len(laps["lap"]):
            self.open.clear()
            return
        self.open.put([_block(laps)])
        self.handle.registerTimer(int(laps["forget"].min()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._sums(df) for df in rows]
        for p in parts:
            p["forget"] = np.maximum(p["forget"], timerValues.getCurrentWatermarkInMs() + 1)
        before = _rows(self.open)
        parts += [before] if before else []
        laps = _added({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})
        ended = laps["ended"] > 0
        self._keep(_taken(laps, ~ended))
        done = _taken(laps, ended & (laps["n"] >= self.min_samples))
        if not len(done["lap"]):
            yield pd.DataFrame()
            return
        out = dict(zip(self.by, [*([v] * len(done["lap"]) for v in key[:-1]), done["lap"]], strict=True)) | {"n_samples": done["n"].astype(np.int64)}
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = lambda c: done[f"sum_{c}"] / done[f"cnt_{c}"]
            share = lambda c: done[c] / done["n"]
            values = (mean("Speed"), done["max_Speed"], mean("Throttle"), share("full"), mean("Brake"), share("braking"), share("drs"), mean("RPM"), mean("nGear"))
        # null, not NaN, without a reading
        yield pd.DataFrame(out | {c: np.where(np.isnan(v), None, v) for c, v in zip(LAP_TELEMETRY, values, strict=True)})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        laps = _rows(self.open)
        if laps:
            self._keep(_taken(laps, laps["forget"] > expiredTimerInfo.getExpiryTimeInMs()))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def lap_telemetry(samples: DataFrame, starts: DataFrame, delay: str = "3 minutes", slice_us: int = SLICE_US,
                  min_samples: int = K.MIN_SAMPLES_PER_LAP, keep_hours: float = 24.0, drs_open_min: int = K.DRS_OPEN_MIN) -> DataFrame:
    """ST1: A1's columns of each lap from its start to the next one.

    ``samples`` (Year, RoundNumber, DriverNumber, ts and the channels) and ``starts`` (the same keys, ts, LapNumber) are
    streams. A lap comes out when the watermark has passed the next start of its car.
    """
    car = ["Year", "RoundNumber", "DriverNumber"]
    keyed = [*(F.col(c) for c in car), F.col("ts")]
    kinds = [(c, samples.schema[c].dataType) for c in CHANNELS]
    asked = samples.select(*keyed, *CHANNELS, F.lit(False).alias("ends"))
    # A start ends the lap before it: it asks for the latest start a microsecond earlier.
    ends = starts.select(*(F.col(c) for c in car), F.timestamp_micros(F.unix_micros("ts") - 1).alias("ts"), *(F.lit(None).cast(t).alias(c) for c, t in kinds), F.lit(True).alias("ends"))
    answers = starts.select(*keyed, "LapNumber", F.unix_micros("ts").alias("lap_start_us"))
    found = asof_stream(asked.unionByName(ends), answers, car, "ts", delay, slice_us, tie="LapNumber").where(F.col("LapNumber").isNotNull())
    by = [*car, "LapNumber"]
    keys = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in by)
    block = F.floor(F.col("LapNumber") / F.lit(LAP_BLOCK)).alias("block")
    return found.select(*by, block, "lap_start_us", "ends", *(F.col(c).cast("double").alias(c) for c in CHANNELS), "et").groupBy(*car, "block").transformWithStateInPandas(
        LapSums(by, min_samples, keep_hours, drs_open_min), f"{keys}, n_samples long, {', '.join(f'{c} double' for c in LAP_TELEMETRY)}", "Append", "EventTime")
