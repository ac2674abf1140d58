"""File edges: CSV, TSV, JSON, text and raw binary in, tables out, with explicit schemas and fail-fast parsing."""
from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import null_if_nan

SPIKES = "session STRING, probe STRING, unit_id BIGINT, spike_s DOUBLE, sample_idx BIGINT"
LABELS = "cluster_id BIGINT, KSLabel STRING"
POSE = "frame BIGINT, center_x DOUBLE, center_y DOUBLE, hd_deg DOUBLE"
INTERVALS = "interval_type STRING, start DOUBLE, `end` DOUBLE"
TRIALS = "session STRING, trial_id BIGINT, onset_s DOUBLE, x_deg DOUBLE, y_deg DOUBLE, size_deg DOUBLE, luminance INT"


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder (spark.checkpoint.dir); a temporary folder only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tunefold-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# ---- readers ----
def read_spikes(spark: SparkSession, path: str, schema: str = SPIKES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_spikes_bucketed(spikes: DataFrame, table: str, buckets: int) -> None:
    """Bucket and sort by recording and unit, so per-recording joins and per-unit aggregates need no shuffle."""
    spikes.write.bucketBy(buckets, "session", "probe", "unit_id").sortBy("session", "probe", "unit_id", "spike_s").saveAsTable(table)


def read_unit_labels(spark: SparkSession, path: str, good: str | None = None) -> DataFrame:
    d = spark.read.schema(LABELS).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)
    return d if good is None else d.filter(F.col("KSLabel") == good)


def read_pose_csv(spark: SparkSession, path: str, clock: DataFrame, schema: str = POSE) -> DataFrame:
    """Pose on the whole frame clock; frames without a pose keep NULLs, NaN becomes NULL."""
    p = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    p = p.select(F.col("frame").alias("frame_id"), *[null_if_nan(c).alias(c) for c in p.columns if c != "frame"])
    return clock.join(p, "frame_id", "left")


def pose_violations(pose: DataFrame) -> DataFrame:
    """Frame ids that repeat, are negative or missing."""
    return pose.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | (F.col("frame") < 0) | F.col("frame").isNull())


def read_motive_pose(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rigid-body CSV with several header rows: data rows are those whose first field is a frame number."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\d+\s*,"))
    cast = lambda i, c: F.trim(parts[i]).try_cast("long" if c == "frame" else "double").alias(c)
    return rows.select(*[cast(i, c) for i, c in enumerate(columns)])


def read_intervals(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    d = spark.read.schema(INTERVALS).option("header", True).option("mode", "FAILFAST").csv(path)
    return d if phase is None else d.filter(F.col("interval_type") == phase)


def scan_interleaved(spark: SparkSession, path: str, n_channels: int, channel: int) -> DataFrame:
    """One channel of an interleaved int16 file: fixed-length records split over tasks, numbered in file order."""
    rec = spark.sparkContext.binaryRecords(path, 2 * n_channels).zipWithIndex()

    def pick(it):
        for raw, i in it:
            yield int(i), int(np.frombuffer(raw, dtype="<i2")[channel])

    return spark.createDataFrame(rec.mapPartitions(pick), "sample_idx BIGINT, v INT")


def session_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per recording descriptor file and stream."""
    stream = "STRUCT<folder_name: STRING, sample_rate: DOUBLE, num_channels: INT, recorded_processor_id: INT>"
    d = spark.read.schema(f"continuous ARRAY<{stream}>").option("multiLine", True).option("pathGlobFilter", "structure.oebin").option("recursiveFileLookup", True).json(root)
    d = d.select(F.input_file_name().alias("path"), F.posexplode("continuous").alias("stream_no", "s"))
    return d.select(F.element_at(F.split("path", "/"), -2).alias("recording"), "stream_no", "s.*", (F.col("stream_no") == 0).alias("is_probe"))


#: Bytes of a file that may be one value of a row; endings that Spark's text reader would unpack.
WHOLE, PACKED = 1 << 26, r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz)$"


def _digested(batches, file: str, length: int):
    h, seen, at = hashlib.sha256(), -1, -1
    for batch in batches:
        lines, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        if not lines:
            continue
        if blocks[0] < at or (np.diff(blocks) < 0).any():
            raise ValueError(f"{file} was not read in order")
        at = blocks[-1]
        if seen >= 0:
            h.update(b"\n")
        part = b"\n".join(lines)
        h.update(part)
        seen += 1 + len(part)
    if seen == length - 1:
        h.update(b"\n")
    elif seen != length:
        raise ValueError(f"read {seen} of the {length} bytes of {file}")
    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([length], pa.int64()), pa.array([h.hexdigest()])], names=["file", "bytes", "sha256"])


def file_evidence(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """Size and SHA-256 of every source file, hashed where the file is read.

    A digest needs a file's bytes in order, so a file is one task. Files of more than `whole` bytes are read as raw lines, piece
    by piece: no row holds such a file, whatever its size. Packed files are one row, as Spark would unpack their lines.
    """
    escaped = lambda p: re.sub(r"([\\*?\[\]{}])", r"\\\1", p)
    rows = lambda f: f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    # the source itself leaves out by length, before it reads a file
    out = rows(f.filter(F.col("length") <= whole))
    for r in f.filter(F.col("length") > whole).select("path", "length").collect():
        if re.search(PACKED, r["path"]):
            out = out.unionByName(rows(spark.read.format("binaryFile").load(escaped(r["path"]))))
            continue
        lines = spark.read.format("text").option("lineSep", "\n").load(escaped(r["path"]))
        lines = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_block_start").alias("at")).coalesce(1)
        out = out.unionByName(lines.mapInArrow(lambda it, file=r["path"].split("/")[-1], n=r["length"]: _digested(it, file, n), "file string, bytes long, sha256 string"))
    return out


# ---- tuning tables ----
def tc_csv_write(curves: DataFrame, path: str, unit: str, axis: str, value: str, centers: list[float], overwrite: bool = False) -> None:
    """Long to wide: one row per opaque unit id, one column per center. Refuses existing output unless told."""
    wide = curves.groupBy(F.col(unit).cast("string").alias("unit_id")).pivot(axis, centers).agg(F.first(value))
    wide.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def tc_csv_read(spark: SparkSession, path: str, centers: list[float] | None = None) -> DataFrame:
    """Wide to long. Ids stay text, empty cells stay missing. Without given centers the header is read first."""
    names = [str(float(c)) for c in centers] if centers else [c for c in spark.read.option("header", True).csv(path).columns if c != "unit_id"]
    schema = T.StructType([T.StructField("unit_id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in names])
    d = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)
    long = d.unpivot(["unit_id"], [F.col(f"`{c}`").alias(c) for c in names], "angle", "value")
    return long.select("unit_id", F.col("angle").cast("double").alias("angle"), null_if_nan("value").alias("value"))


def tc_json_write(curves: DataFrame, path: str, unit: list[str], overwrite: bool = False) -> None:
    """One JSON row per unit with arrays over bins; NaN is written as null."""
    g = curves.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("bin", "n_spikes", "occ_s", null_if_nan("rate_hz").alias("rate_hz")))).alias("_b"))
    g = g.select(*unit, F.col("_b.bin").alias("bin"), F.col("_b.n_spikes").alias("spike_counts"), F.col("_b.occ_s").alias("occupancy_s"), F.col("_b.rate_hz").alias("firing_rate_hz"))
    g.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def tc_json_read(spark: SparkSession, path: str, unit_schema: str) -> DataFrame:
    s = f"{unit_schema}, bin ARRAY<INT>, spike_counts ARRAY<BIGINT>, occupancy_s ARRAY<DOUBLE>, firing_rate_hz ARRAY<DOUBLE>"
    d = spark.read.schema(s).json(path)
    unit = [c for c in d.columns if c not in ("bin", "spike_counts", "occupancy_s", "firing_rate_hz")]
    z = d.select(*unit, F.explode(F.arrays_zip("bin", "spike_counts", "occupancy_s", "firing_rate_hz")).alias("z"))
    return z.select(*unit, "z.bin", F.col("z.spike_counts").alias("n_spikes"), F.col("z.occupancy_s").alias("occ_s"), F.col("z.firing_rate_hz").alias("rate_hz"))


def columnar_tc_read(spark: SparkSession, path: str) -> DataFrame:
    """Columnar document (unit_id list, counts per unit, occupancy per bin) to unit x bin rows."""
    d = spark.read.schema("unit_id ARRAY<BIGINT>, spike_counts ARRAY<ARRAY<BIGINT>>, occupancy_time_s ARRAY<DOUBLE>").option("multiLine", True).json(path)
    u = d.select("occupancy_time_s", F.explode(F.arrays_zip("unit_id", "spike_counts")).alias("u"))
    b = u.select(F.col("u.unit_id").alias("unit_id"), F.posexplode(F.arrays_zip(F.col("u.spike_counts").alias("n"), F.col("occupancy_time_s").alias("o"))).alias("bin", "z"))
    return b.select("unit_id", "bin", F.col("z.n").alias("n_spikes"), F.col("z.o").alias("occ_s")).withColumn("rate_hz", F.when(F.col("occ_s") > 0, F.col("n_spikes") / F.col("occ_s")))


# ---- cubes, masks, runs ----
def cube_violations(cube: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Broken rules as rows: duplicate cells, negative counts, counts without a presentation."""
    dup = cube.groupBy(*keys, "y", "x", "t_bin").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys, "y", "x", "t_bin", F.lit("duplicate_cell").alias("rule"))
    j = cube.join(grid, ["y", "x"], "left")
    rule = F.when(F.col("n") < 0, "negative_count").when((F.coalesce("presentations", F.lit(0)) == 0) & (F.col("n") > 0), "count_without_presentation")
    return dup.unionByName(j.withColumn("rule", rule).filter("rule IS NOT NULL").select(*keys, "y", "x", "t_bin", "rule"))


def write_bands(maps: DataFrame, path: str, overwrite: bool = False) -> None:
    """Full map and band maps in one table, one folder per band."""
    maps.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("band").parquet(path)


def content_key(df: DataFrame, params: dict) -> DataFrame:
    """Order-free SHA-256 over rows and settings. Row hashes are summed as exact decimals before the final hash,
    so no row order and no row list is ever collected."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    text = "|".join(f"{k}={params[k]}" for k in sorted(params))
    return df.agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[part(i) for i in range(4)]).alias("_c")).select(F.sha2(F.concat_ws("#", F.col("_c"), F.lit(text)), 256).alias("key"))


def save_run(tables: dict[str, DataFrame], root: str, run_id: str, manifest: dict[str, str]) -> None:
    """A run is a folder of tables plus a manifest table; an existing run is never overwritten."""
    for name, t in tables.items():
        t.write.mode("errorifexists").parquet(f"{root}/{run_id}/{name}")
    any_t = next(iter(tables.values()))
    rows = any_t.sparkSession.createDataFrame([(run_id, k, str(v)) for k, v in sorted(manifest.items())], "run_id STRING, key STRING, value STRING")
    rows.write.mode("errorifexists").parquet(f"{root}/{run_id}/manifest")


def load_run(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{run_id}/{name}")


# ---- logs, lists, catalogs, edits ----
def parse_event_log(lines: DataFrame, pattern: str = r"label=(\w+) index=(\d+) cycle=(\d+)") -> DataFrame:
    """Labels with the sorted cycles they occur in; 'empty' with index 1 means Center."""
    g = lambda i: F.regexp_extract("value", pattern, i)
    e = lines.select(g(1).alias("raw"), g(2).alias("idx"), g(3).alias("cycle")).filter(F.col("raw") != "")
    lab = F.when((F.col("raw") == "empty") & (F.col("idx") == "1"), "Center").otherwise(F.col("raw"))
    return e.select(lab.alias("label"), F.col("cycle").cast("long").alias("cycle")).groupBy("label").agg(F.sort_array(F.collect_set("cycle")).alias("cycles"))


def merge_lists(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """Lists of the same key concatenated, a first; a key on one side keeps its list."""
    j = a.select(key, F.col(values).alias("_a")).join(b.select(key, F.col(values).alias("_b")), key, "full_outer")
    e = F.array().cast(a.schema[values].dataType)
    return j.select(key, F.concat(F.coalesce("_a", e), F.coalesce("_b", e)).alias(values))


def flatten_leaves(df: DataFrame, keys: list[str], nested: str, depth: int) -> DataFrame:
    """Leaves of `depth` nested maps as path and value; missing leaves stay NULL."""
    cur = df.select(*keys, F.array().cast("array<string>").alias("path"), F.col(nested).alias("_v"))
    for _ in range(depth):
        cur = cur.select(*keys, "path", F.explode("_v").alias("_k", "_v")).withColumn("path", F.concat("path", F.array(F.col("_k").cast("string")))).drop("_k")
    return cur.withColumn("path", F.concat_ws(".", "path")).withColumnRenamed("_v", "value")


def discover_session_pairs(runs: DataFrame, units: DataFrame, kinds: tuple[str, str], *, min_coverage: float = 0.9, min_shared: int = 3) -> DataFrame:
    """Pairs of runs of two kinds on the same probe, day and sorting source, well covered, sharing enough units."""
    ok = runs.filter(F.col("coverage") > min_coverage)
    on = ["mouse", "date", "probe", "sort_source"]
    # a run's units travel in its row as bits, numbered within what runs can be paired in; the pairs are judged where they meet
    u = ok.filter(F.col("kind").isin(*kinds)).select(*on, "kind", "run_id").join(units.filter(F.col("unit_id").isNotNull()), "run_id")
    u = u.withColumn("_i", F.dense_rank().over(Window.partitionBy(*on).orderBy("unit_id")) - 1)
    u = u.groupBy(*on, "kind", "run_id").agg(F.collect_set("_i").alias("_u"))
    bits = lambda w: F.aggregate("_u", F.lit(0).cast("long"), lambda acc, i: F.when(F.floor(i / 64) == w, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64))).otherwise(acc))
    words = F.floor(F.array_max("_u") / 64).cast("int")
    u = u.select(*on, "kind", "run_id", bits(F.lit(0)).alias("_b"), F.when(words > 0, F.transform(F.sequence(F.lit(1), F.greatest(words, F.lit(1))), bits)).alias("_m"))
    a, b = (u.filter(F.col("kind") == k).select(*on, F.col("run_id").alias(f"run_{s}"), F.col("_b").alias(f"_b{s}"), F.col("_m").alias(f"_m{s}")) for s, k in zip("ab", kinds))
    # only with more than 64 units at hand there is more than one number to a run
    more = F.aggregate(F.zip_with("_ma", "_mb", lambda x, y: F.bit_count(F.coalesce(x.bitwiseAND(y), F.lit(0).cast("long")))), F.lit(0), lambda acc, n: acc + n)
    shared = (F.bit_count(F.col("_ba").bitwiseAND(F.col("_bb"))) + F.when(F.col("_ma").isNotNull() & F.col("_mb").isNotNull(), more).otherwise(F.lit(0))).cast("long")
    p = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on] + [shared >= min_shared])
    return p.select(*[F.col(f"a.{k}") for k in on], "run_a", "run_b", shared.alias("n_shared"))


def session_edit_upsert(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append delete frames (first appearance wins), set, replace or clear the interpolation.

    `new` adds `op` (delete, interp, clear). Deleting after an interpolation is set is refused and reported.
    """
    on = ["date", "session_id"]
    j = old.select(*on, F.col("delete_frames").alias("_d"), F.col("interp").alias("_i")).join(new, on, "full_outer")
    bad = (F.col("op") == "delete") & F.col("_i").isNotNull()
    e = F.array().cast("array<int>")
    d0, d1 = F.coalesce("_d", e), F.coalesce("delete_frames", e)
    d = F.when((F.col("op") == "delete") & ~bad, F.array_distinct(F.concat(d0, d1))).otherwise(d0)
    i = F.when(F.col("op") == "interp", F.col("interp")).when(F.col("op") == "clear", F.lit(None)).otherwise(F.col("_i"))
    return j.select(*on, d.alias("delete_frames"), i.alias("interp")), j.filter(bad).select(*on, F.lit("delete_after_interpolation").alias("rule"))
