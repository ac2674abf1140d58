"""Structured Streaming forms of the pulse, tuning, trial-window and rate operators."""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.bins import angle_bin

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as a stream; new files with the same name pattern would be picked up."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def closed(stream: DataFrame, path: str, ts: str, key: str, at: str = "2200-01-01") -> DataFrame:
    """The stream with one last row at a time after all others, so that a replay of a finished recording passes every watermark.

    The row has an empty key (0 or '') and nulls otherwise, so it counts nowhere. For sources that are read in one batch:
    what comes after it is late.
    """
    spark = stream.sparkSession
    value = lambda f: F.to_timestamp(F.lit(at)) if f.name == ts else F.lit("" if f.dataType.simpleString() == "string" else 0) if f.name == key else F.lit(None)
    spark.range(1).select(*[value(f).cast(f.dataType).alias(f.name) for f in stream.schema]).write.mode("overwrite").parquet(f"{path}/end")
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{path}/end"))


class _Held(StatefulProcessor):
    """Rows of a key wait until the watermark has passed their time, then they are looked at in order of time.

    One timer per key stands at the earliest waiting row. Rows behind the watermark never arrive here: Spark drops them.
    """

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.timer = handle.getValueState("timer", "at BIGINT")
        self.prepare(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for df in rows:
            df = df.dropna(subset=self.needed)  # here, as a filter before would take the closing row from the watermark
            if len(df):
                self.waiting.appendList(self.tuples(df))
                least = int(df["us"].min()) // 1000
                first = least if first is None else min(first, least)
        self.set_timer(first)
        return iter(())

    def tuples(self, df: pd.DataFrame) -> list[tuple]:
        """Rows for the state, whose types are strict."""
        kind = {"us": int, "place": int, "unit": int, "on": bool, "angle": float}
        return list(zip(*[[None if pd.isna(v) else kind[c](v) for v in df[c]] for c in self.columns]))

    def set_timer(self, first: int | None) -> None:
        old = self.timer.get() if self.timer.exists() else None
        if first is not None and (old is None or first < old[0]):
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        df = pd.DataFrame(list(self.waiting.get()), columns=self.columns)
        out, kept = self.released(key, df.sort_values(["us", *self.ties], kind="stable"), passed)
        self.waiting.clear()
        if len(kept):
            self.waiting.put(self.tuples(kept))
            later = kept["us"].to_numpy() // 1000
            later = later[later > passed]
            if len(later):
                self.set_timer(int(later.min()))
        yield out

    def close(self) -> None:
        pass


class _Pulses(_Held):
    waiting_schema, columns, ties, needed = "us BIGINT, place BIGINT, on BOOLEAN", ["us", "place", "on"], ["place", "on"], ["us", "on"]

    def __init__(self, key: str) -> None:
        self.key = key

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "last BOOLEAN, rise BIGINT")

    def released(self, key, df: pd.DataFrame, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        ready = df["us"].to_numpy() // 1000 <= passed
        now, us = df["on"].to_numpy()[ready].astype(bool), df["us"].to_numpy()[ready]
        last, rise = self.level.get() if self.level.exists() else (None, None)
        ends = pd.DataFrame({self.key: [], "start_us": [], "end_us": []})
        if len(now):
            before = np.append(now[0] if last is None else last, now[:-1])
            up, down = us[now & ~before], us[~now & before]
            up = up if rise is None else np.append(rise, up)
            down = down[1:] if len(down) and (not len(up) or down[0] < up[0]) else down
            ends = pd.DataFrame({self.key: [key[0]] * len(down), "start_us": up[: len(down)], "end_us": down})
            self.level.update((bool(now[-1]), int(up[-1]) if len(up) > len(down) else None))
        return ends, df[~ready]


def stream_pulses(samples: DataFrame, key: str, ts: str, on: str, late: str = "1 hour", place: str | None = None) -> DataFrame:
    """Rise-to-fall pulses (key, start_us, end_us) with the level and an open rise carried along, in append mode.

    Samples may come `late` behind the latest: they wait in state until the watermark has passed and are then ordered, so
    overlapping batches give what one sorted batch gives. Samples without key, time or level are left out; those later
    than the watermark are dropped and never change the level. At equal times samples go by the long `place` if given
    (nulls last), then off comes before on.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = samples.withWatermark(ts, late).filter(F.col(key).isNotNull()).select(key, ts, F.unix_micros(ts).alias("us"), (F.col(place) if place else F.lit(None)).cast("long").alias("place"), F.col(on).alias("on"))
    return rows.groupBy(key).transformWithStateInPandas(_Pulses(key), f"{key} {dict(samples.dtypes)[key]}, start_us BIGINT, end_us BIGINT", "append", "eventTime")


class _Nearest(_Held):
    waiting_schema, columns, ties, needed = "us BIGINT, unit BIGINT, angle DOUBLE", ["us", "unit", "angle"], [], ["us", "mark"]

    def __init__(self, key: str, horizon_us: int) -> None:
        self.key, self.horizon_us = key, horizon_us

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        pass

    def released(self, key, df: pd.DataFrame, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        us, is_spike = df["us"].to_numpy(), df["unit"].notna().to_numpy()
        frame, angle = us[~is_spike], df["angle"].to_numpy(dtype=float)[~is_spike]
        known = frame // 1000 <= passed  # frames up to the watermark are all here
        frame, angle = frame[known], angle[known]
        after = np.searchsorted(frame, us, "left")
        ready = is_spike & (us // 1000 <= passed) & ((after < len(frame)) | ((us + self.horizon_us) // 1000 <= passed))
        t = us[ready]
        i = after[ready]
        left, right = np.maximum(i - 1, 0), np.minimum(i, max(0, len(frame) - 1))
        if len(frame):
            gap = lambda j: np.abs(frame[j] - t)
            best = np.where((i > 0) & ((i >= len(frame)) | (gap(left) <= gap(right))), left, right)
            best = np.searchsorted(frame, frame[best], "left")  # of frames at one time the first
            near = gap(best) <= self.horizon_us
        else:
            best, near = left, np.zeros(len(t), bool)
        out = pd.DataFrame({self.key: [key[0]] * len(t), "unit": df["unit"].to_numpy()[ready].astype(np.int64), "ts": pd.to_datetime(t, unit="us"), "angle": np.where(near, angle[best], np.nan) if len(frame) else np.full(len(t), np.nan)})
        waits = is_spike & ~ready
        oldest = min([us[waits].min() if waits.any() else np.inf, passed * 1000.0])
        last = frame[frame <= oldest].max(initial=np.iinfo(np.int64).min) if len(frame) else np.iinfo(np.int64).min
        return out, df[waits | (~is_spike & (us >= last))]


def stream_nearest(spikes: DataFrame, frames: DataFrame, key: str, ts: str, unit: str, angle: str, late: str = "1 hour", horizon_s: float = 86400.0) -> DataFrame:
    """(key, unit, ts, angle): every spike with the angle of the frame nearest in time, the earlier of two as near, NaN beyond the horizon.

    Both streams share one watermark. A spike waits until a frame behind it is known or the horizon has passed; of the frames
    state keeps those from the last one before the oldest waiting spike on. Frames without an angle and rows without key,
    time or unit are left out; late rows are dropped.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    one = spikes.select(key, ts, F.col(unit).cast("long").alias("unit"), F.lit(None).cast("double").alias("angle"))
    two = frames.select(key, ts, F.lit(None).cast("long").alias("unit"), F.nanvl(F.col(angle).cast("double"), F.lit(None).cast("double")).alias("angle"))
    mark = F.coalesce(F.col("unit").cast("double"), "angle").alias("mark")
    rows = one.unionByName(two).withWatermark(ts, late).filter(F.col(key).isNotNull()).select(key, ts, F.unix_micros(ts).alias("us"), "unit", "angle", mark)
    return rows.groupBy(key).transformWithStateInPandas(_Nearest(key, int(horizon_s * 1e6)), f"{key} {dict(spikes.dtypes)[key]}, unit BIGINT, ts TIMESTAMP, angle DOUBLE", "append", "eventTime")


def stream_tuning(spikes: DataFrame, frames: DataFrame, key: str, ts: str, angle: str, n: int, fs: float, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Spikes, exposure and rate per window, unit and angle bin: two watermarked aggregates of streams, joined.

    spikes: key, unit, ts, angle, as stream_nearest() gives them; frames: key, ts, angle. A row comes out when the watermark
    has passed its window, in append mode; n_spikes is 0 and unit null where a bin has exposure and no spike. Sums over the
    windows are those of the whole recording: rates() makes curves of them. Rows without a key are left out, those without
    an angle are counted under bin -1, which rates() does not show.
    """
    bin_ = F.coalesce(F.when(~F.isnan(angle), angle_bin(angle, n)), F.lit(-1)).cast("int").alias("bin")
    part = lambda df, more: df.withWatermark(ts, late).filter(F.col(key).isNotNull()).groupBy(F.window(ts, window).alias("window"), key, *more, bin_).agg(F.count(F.lit(1)).alias("n"))
    counts = part(spikes, ["unit"]).select(key, "window", "bin", "unit", F.col("n").alias("n_spikes")).alias("s")
    seen = part(frames, []).select(key, "window", "bin", (F.col("n") / fs).alias("occ_s")).alias("f")
    same = (F.col(f"s.{key}") == F.col(f"f.{key}")) & (F.col("s.window") == F.col("f.window")) & (F.col("s.bin") == F.col("f.bin"))  # on windows: the watermark bounds the join's state
    both = seen.join(counts, same, "full_outer")
    out = both.select(F.coalesce(f"f.{key}", f"s.{key}").alias(key), F.coalesce("f.window", "s.window").alias("window"), F.coalesce("f.bin", "s.bin").alias("bin"), "unit",
                      F.coalesce("n_spikes", F.lit(0).cast("long")).alias("n_spikes"), "occ_s")
    return out.select(key, F.unix_micros("window.start").alias("start_us"), "bin", "unit", "n_spikes", "occ_s", F.when(F.col("occ_s") > 0, F.col("n_spikes") / F.col("occ_s")).alias("rate_hz"))


def rates(windows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, unit, bin, n_spikes, occ_s, rate_hz) over all windows of stream_tuning(), dense in the bins of every unit."""
    from ..operators.dense import dense_fixed
    # a window's exposure stands beside every unit that fired in it: take it once
    occ = windows.groupBy(key, "start_us", "bin").agg(F.max("occ_s").alias("occ_s")).groupBy(key, "bin").agg(F.sum("occ_s").alias("occ_s"))
    # a unit that never fired in a bin still has a curve
    fired = windows.filter("unit is not null").select(key, "unit", F.greatest("bin", F.lit(0)).alias("bin"), F.when(F.col("bin") < 0, 0).otherwise(F.col("n_spikes")).alias("n_spikes"))
    counts = fired.groupBy(key, "unit", "bin").agg(F.sum("n_spikes").alias("n_spikes"))
    dense = dense_fixed(counts, [key, "unit"], {"bin": n}, ["n_spikes"], fill=0)
    return dense.join(occ, [key, "bin"], "left").withColumn("rate_hz", F.when(F.col("occ_s") > 0, F.col("n_spikes") / F.col("occ_s")))


def stream_trial_counts(spikes: DataFrame, trials: DataFrame, keys: list[str], ts: str, onset: str, lo: str, hi: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream join of spikes in [onset+lo, onset+hi); watermarks bound the join state on both sides.

    A trial is held once for every stretch of time, of the window's length, that its window meets (two at most for windows
    of fixed length) and a spike in one, so a row is compared with the state of its stretch and not with that of its whole key.
    """
    at = lambda t, by: F.unix_micros(t + F.expr(f"INTERVAL {by}"))
    zero = F.timestamp_micros(F.lit(0))
    long = F.greatest(at(zero, hi) - at(zero, lo), F.lit(1))
    part = lambda us: F.floor(us / long).cast("long")
    s = spikes.withWatermark(ts, late).withColumn("_part", part(F.unix_micros(ts))).alias("s")
    # a bound rounded to the other side of an edge must not lose a stretch
    first, after = part(at(F.col(onset), lo) - 1), part(at(F.col(onset), hi) + 1)
    r = trials.withWatermark(onset, late).withColumn("_part", F.explode(F.sequence(first, F.greatest(first, after)))).alias("r")
    on = [F.col(f"s.{k}") == F.col(f"r.{k}") for k in [*keys, "_part"]]
    on += [F.col(f"s.{ts}") >= F.col(f"r.{onset}") + F.expr(f"INTERVAL {lo}"), F.col(f"s.{ts}") < F.col(f"r.{onset}") + F.expr(f"INTERVAL {hi}")]
    return s.join(r, on, "inner").select(*[F.col(f"s.{c}") for c in spikes.columns], *[F.col(f"r.{c}") for c in trials.columns if c not in spikes.columns])


def stream_window_counts(spikes: DataFrame, trials: DataFrame, keys: list[str], trial: str, ts: str, onset: str, lo: str, hi: str, late: str = "1 hour", stretch_s: int = 3600) -> DataFrame:
    """(keys, trial, n): spikes in [onset+lo, onset+hi) per trial and stretch of time, in append mode; a trial's sum is its count.

    Spikes and trials are two watermarked aggregates, lists of a key's times per stretch, and joined by stretch: a trial meets
    lists of spikes and counts in them, so no pair of a spike and a trial is a row. Trials and stretches without a hit give no row.
    """
    part, window = lambda c: F.floor(c / F.lit(stretch_s * 1_000_000)).cast("long"), f"{stretch_s} seconds"
    present = lambda *cols: F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))

    @F.pandas_udf("array<long>")
    def counts(times: pd.Series, first: pd.Series, after: pd.Series) -> pd.Series:
        sorted_ = [np.sort(np.asarray(t, np.int64)) for t in times]
        return pd.Series([np.maximum(np.searchsorted(t, b, "left") - np.searchsorted(t, a, "left"), 0) for t, a, b in zip(sorted_, first, after)], dtype=object)

    s = spikes.withWatermark(ts, late).filter(present(*keys)).groupBy(*keys, F.window(ts, window).alias("_w")).agg(F.collect_list(F.unix_micros(ts)).alias("_t"))
    s = s.select(*keys, F.window_time("_w").alias("_st"), part(F.unix_micros("_w.start")).alias("_part"), "_t").alias("s")
    at = lambda by: F.unix_micros(F.col(onset) + F.expr(f"INTERVAL {by}"))
    row = F.struct(F.col(trial).alias("i"), at(lo).alias("a"), at(hi).alias("b"))
    r = trials.withWatermark(onset, late).filter(present(*keys)).groupBy(*keys, F.window(onset, window).alias("_w")).agg(F.collect_list(row).alias("_r"))
    first, last = part(F.array_min("_r.a")), part(F.array_max("_r.b"))
    r = r.select(*keys, F.window_time("_w").alias("_rt"), F.explode(F.sequence(first, F.greatest(first, last))).alias("_part"), "_r").alias("r")
    # the condition on times lets the watermark clear both sides
    on = [F.col(f"s.{k}") == F.col(f"r.{k}") for k in [*keys, "_part"]]
    on += [F.col("_st") >= F.col("_rt") + F.expr(f"INTERVAL {lo}") - F.expr(f"INTERVAL '{2 * stretch_s}' SECOND"), F.col("_st") <= F.col("_rt") + F.expr(f"INTERVAL {hi}") + F.expr(f"INTERVAL '{2 * stretch_s}' SECOND")]
    j = s.join(r, on, "inner").select(*[F.col(f"s.{k}") for k in keys], F.col("_r.i").alias("_i"), counts("_t", "_r.a", "_r.b").alias("_n"))
    return j.select(*keys, F.explode(F.arrays_zip("_i", "_n")).alias("_x")).select(*keys, F.col("_x._i").alias(trial), F.col("_x._n").alias("n")).filter("n > 0")


def stream_rate(events: DataFrame, keys: list[str], ts: str, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per tumbling (or sliding) window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = events.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.unix_micros("w.start").alias("start_us"), "n")


def stream_bursts(events: DataFrame, keys: list[str], ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of events closer than the gap."""
    g = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return g.select(*keys, F.unix_micros("_a").alias("first_us"), F.unix_micros("_b").alias("last_us"), "n")


def drain(stream: DataFrame, path: str, *, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Process everything available, then return the sink as a batch table. In update mode the latest row per key counts."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out").drop("epoch")
    if mode != "update":
        return out.drop("_epoch")
    vals = [c for c in out.columns if c not in (*keys, "_epoch")]
    g = out.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_epoch").alias("v"))
    return g.select(*keys, "v.*")
