"""Session helpers: reliable checkpoints and joins against per-group summary tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side holds at most this many bytes of values; above it the join is salted.
BROADCAST_BYTES = 32 << 20
SALTS = 16


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxcohort-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder, so that reuse is cheap and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(table: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a computed table can be sent to every task, by what its rows hold: 16 bytes a row and their values as text."""
    values = [f.name for f in table.schema.fields if f.dataType.typeName() not in ("variant", "binary")]
    binaries = [F.coalesce(F.length(f.name), F.lit(0)) for f in table.schema.fields if f.dataType.typeName() == "binary"]
    width = sum(binaries, F.coalesce(F.length(F.to_json(F.struct(*values))), F.lit(0)) + 16 if values else F.lit(16))
    found = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found["bytes"] <= BROADCAST_BYTES and (max_rows is None or found["rows"] <= max_rows)


def join_summary(df: DataFrame, summary: DataFrame, on: list[str], how: str, small: bool) -> DataFrame:
    """Join with a table that has one row per key: broadcast if it is known to be small, else salted.

    The salt spreads the rows of a hot key over ``SALTS`` tasks; the summary is copied once per salt.
    """
    if small:
        return df.join(F.broadcast(summary), on, how)
    hashable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
    copies = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def attach(df: DataFrame, summary: DataFrame, on: list[str], how: str = "inner",
           max_rows: int | None = None) -> DataFrame:
    """Join a large table with a summary that has one row per ``on`` key.

    The summary is computed once and measured, so that the large side is shuffled only if the summary
    is too large to broadcast.
    """
    summary = settle(summary)
    return join_summary(df, summary, on, how, fits_broadcast(summary, max_rows))
