"""Reading the driver tables, folds, the shared folder and bounded collects."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.arrays import blocks
from wardline.session import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    back = spark.read.schema(df.schema).parquet(folder)
    back._folder = folder
    return back


def forget(*frames: DataFrame | None) -> None:
    """Remove the folders of ``written`` tables that nothing will read any more."""
    for df in frames:
        if df is not None and hasattr(df, "_folder"):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n`` (null: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Collect rows that a parameter bounds; more than that is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; raise the bound")
    return rows


BROADCAST_LABELS = 2_000_000


def with_label(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``docs`` with a column ``y`` (0, 1 or null).  A doc labelled twice has its least label.

    The label rows are broadcast when a count proves them few; both plans give the same rows.
    """
    y = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
         .groupBy("doc_id").agg(F.min(label).cast("int").alias("y")))
    if labels.count() <= BROADCAST_LABELS:
        y = F.broadcast(y)
    return docs.join(y, "doc_id", "left")


def scalar(fn, kind: str):
    """An Arrow UDF over one column that works block by block; ``fn``: pa.Array -> pa.Array."""
    def apply(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return fn(column)
        parts = [fn(b.column(0)) for b in blocks([pa.RecordBatch.from_arrays([column], ["text"])], "text")]
        return pa.concat_arrays(parts)

    return F.arrow_udf(apply, kind).asNondeterministic()
