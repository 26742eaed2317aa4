"""Shared pieces of the operators: published tables, words, safe Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.session import new_table_path

#: Fixed value: a word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def publish(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and keeps costly
    passes over texts from being made twice. The read uses the known schema.
    """
    spark: SparkSession = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.published_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove published tables that nothing reads any more: everything made of them has been published itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.published_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def rows_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with its texts as a Python list."""
    for batch in batches:
        yield batch, batch.column(text).to_pylist()


#: Bits of a sketch: 4 MB, whatever the size of the table.
SKETCH_BITS = 1 << 25


def _place() -> Column:
    return F.pmod(F.col("h"), F.lit(SKETCH_BITS).cast("long"))


def sketch_of(hashes: DataFrame) -> DataFrame:
    """``_bucket, _bits``: which hashes ``h`` there are, modulo the size of the sketch, which is fixed."""
    return hashes.groupBy(F.bitmap_bucket_number(_place()).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_place())).alias("_bits"))


def _looked_up(rows: DataFrame, sketch: DataFrame, how: str) -> tuple[DataFrame, Column]:
    near = rows.withColumn("_bucket", F.bitmap_bucket_number(_place())).join(
        F.broadcast(sketch),  # SKETCH_BITS / 8 bytes in one row for each 4 KB at most, however large the table
        "_bucket",
        how,
    )
    at = F.bitmap_bit_position(_place())
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return near, byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0


def in_sketch(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """Rows whose hash ``h`` is in the sketch, and a few others."""
    near, held = _looked_up(rows, sketch, "inner")
    return near.where(held).select(*rows.columns)


def not_in_sketch(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """All rows that ``in_sketch`` leaves out, those without a hash among them."""
    near, held = _looked_up(rows, sketch, "left")
    return near.where(~F.coalesce(held, F.lit(False))).select(*rows.columns)
