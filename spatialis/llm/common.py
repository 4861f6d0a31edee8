"""What the corpus operators share: table access, staged tables and text keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; read by Spark alone, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where the session names none, one is set if all runs on this machine; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spatialis-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here, and a lost executor
    costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spatialis-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, as two longs."""
    return F.struct(F.xxhash64(F.lit(11), text).alias("a"), F.xxhash64(text, F.lit(29), F.length(text)).alias("b"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` has none of."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def text_chunks(batches: Iterator[pa.RecordBatch], chars: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows in order, about `chars` characters of text at a time, with their texts."""
    for b in batches:
        texts = b.column(b.schema.get_field_index(text)).to_pylist()
        at = size = 0
        for i, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= chars or i == len(texts):
                yield b.slice(at, i - at), texts[at:i]
                at, size = i, 0


def partitions(spark: SparkSession, times: int = 1) -> int:
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))
