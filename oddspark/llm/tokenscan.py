"""Token counts of documents in flat, unindexed token files.

A token file is a run of unsigned 16-bit ids in which an end id closes each document;
nothing says where documents are. Files are cut into blocks, each block is searched
for the end id at once (no loop over tokens), and a prefix scan over the blocks of a
file carries the place where the open document began across block boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddspark.llm.common import publish, text_of
from oddspark.llm.tokens import Encoder, default_path
from oddspark.session import new_table_path

#: End id: the largest that fits, outside of every vocabulary here.
END_ID = 65535
WIDTH = 2
#: Tokens of a block; bytes after which a writer begins a new file.
BLOCK_TOKENS = 1 << 18
FILE_BYTES = 8_000_000


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids as token files to a shared folder; returns the manifest ``file, doc_no, doc_id``.

    Files are named by partition and written aside first, so a task that runs again
    replaces its files by the same ones. Null and empty texts are an end id alone.
    """
    vocabulary = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        encoder, end = Encoder.of(vocabulary, WIDTH), int(end_id).to_bytes(WIDTH, "little")
        part, number = TaskContext.get().partitionId(), 0
        stream = aside = name = None
        written = doc_no = 0

        def close() -> None:
            stream.close()
            system.move(aside, f"{folder}/{name}")

        for batch in batches:
            out: list[list] = [[], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if stream is None or written >= FILE_BYTES:
                    if stream is not None:
                        close()
                    name, number = f"tokens-{part:06d}-{number:05d}.u16", number + 1
                    aside = f"{folder}/_{name}.{uuid.uuid4().hex}"
                    stream, written, doc_no = system.open_output_stream(aside), 0, 0
                raw = encoder.encode(text.as_py()) + end
                stream.write(raw)
                for column, value in zip(out, (name, doc_no, doc_id)):
                    column.append(value)
                written, doc_no = written + len(raw), doc_no + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["file", "doc_no", "doc_id"]
            )
        if stream is not None:
            close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return publish(rows.mapInArrow(write, "file string, doc_no long, doc_id long"), "manifest")


def scan(spark: SparkSession, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, doc_no, start, tokens, closed`` of every document in the token files of a folder.

    ``start`` is the document's first token in its file, ``tokens`` leaves out the end
    id. Tokens after the last end id of a file are a document that is not closed. An
    odd last byte is no token. The window runs over the blocks of one file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.u16").load(path)
    size = block_tokens * WIDTH
    blocks = files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))).alias("block"),
    ).select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ends, total = [], []
            for block, ids in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = ids.as_buffer()
                tokens = np.frombuffer(raw, "<u2", len(raw) // WIDTH)
                ends.append(np.flatnonzero(tokens == end_id) + block * block_tokens)
                total.append(block * block_tokens + len(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(total, pa.int64())], ["file", "block", "ends", "upto"]
            )

    found = blocks.mapInArrow(search, "file string, block long, ends array<long>, upto long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1)
    zero = F.lit(0).cast("long")
    carried = found.select(
        "file", "ends", "upto",
        F.coalesce(F.max(last).over(earlier), zero).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(earlier), zero).alias("before"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
        last.alias("last"),
    )
    starts = F.concat(F.array("open"), F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1))
    closed = carried.where(F.size("ends") > 0).select("file", "before", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("n", "d"))
    closed = closed.select(
        "file", (F.col("before") + F.col("n")).alias("doc_no"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("tokens"), F.lit(True).alias("closed")
    )
    begun = F.coalesce("last", "open")
    rest = carried.where("final").where(F.col("upto") > begun)
    rest = rest.select(
        "file", (F.col("before") + F.size("ends")).alias("doc_no"), begun.alias("start"), (F.col("upto") - begun).alias("tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, file, doc_no, start``: documents written as token files, and counted by the scan of these."""
    spark = docs.sparkSession
    path = new_table_path(spark, "tokens")
    manifest = write_files(docs, path, tokenizer)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "doc_no", F.lit(0).cast("long").alias("start"))
    counted = scan(spark, path).withColumnRenamed("tokens", "n_tokens")
    return manifest.join(counted, ["file", "doc_no"]).select("doc_id", "n_tokens", "file", "doc_no", "start")
