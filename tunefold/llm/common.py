"""Column helpers and the shared folder that the training-data operators use."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

__all__ = ["carried", "digest_bits", "read_table", "shared_folder", "ship", "small_batches", "stable"]

#: Bytes of a batch of rows handed to a Python worker: the JVM and the worker hold one at once. Spark's own default is eight times as much.
ARROW_BATCH, SET, DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(keep: list[str] | None, made: list[str]) -> list[str]:
    """Input columns to carry along; a name that the operator itself makes wins over a carried one."""
    low = {m.lower() for m in made}
    return [c for c in keep or [] if c.lower() not in low]


def digest_bits(*parts: Column | str, bits: int = 52) -> Column:
    """Leading bits of md5 over the parts joined by '|' (null: the word null), as a long; the same draw in plain SQL."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster has it there or by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))


def small_batches(spark: SparkSession) -> None:
    """Keep batches for Python workers to ARROW_BATCH bytes, unless the session has a bound of its own."""
    if spark.conf.get(SET, DEFAULT) == DEFAULT:
        spark.conf.set(SET, str(ARROW_BATCH))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """New folder name below spark.checkpoint.dir. Only a local session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tunefold-shared-")
    return f"{root.rstrip('/')}/tunefold-{kind}-{uuid.uuid4().hex}"


def stable(df: DataFrame, kind: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: later steps neither repeat the work nor lose it with an executor."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
