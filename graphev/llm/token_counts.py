"""Token counts of documents in flat token files without an index.

A file is a run of little-endian 16-bit ids; each document ends with the end-of-document id, by
default a number that is no id of the vocabulary, so that texts cannot hold it. Tasks
read files in blocks of ``block`` ids and find the separators of a block in one vectorised
comparison. A block knows nothing of its neighbours: where a document began before the block is
stitched by a prefix scan over the blocks of a stream (the last separator and the number of
separators in all earlier blocks), as a window over one small row per block. Only then do
separators become documents, with their place and count.

A stream is a list of files in order; documents may run on from one file into the next. Ids after
the last separator are a document that was cut off; they are counted with ``ended`` false. Two
separators in a row enclose an empty document. Empty files have no documents.

The writer is Spark's text writer with the separator's bytes as line end, so that files go where
Spark can write; at most ``FILE_DOCS`` documents make a file, which bounds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphev.llm.common import new_dir, table
from graphev.llm.tokens import END_MARK, token_rows

BLOCK, FILE_DOCS = 1 << 20, 10_000
NAME = r"part-(\d+)-.*?(?:-c(\d+))?\.txt"


def write_token_files(docs: DataFrame, folder: str, end: int = END_MARK) -> None:
    """One stream for each task of the scan of docs, documents in the order of the scan."""
    rows = token_rows(docs, end)
    body = F.expr("substring(ids, 1, length(ids) - 2)").cast("string")
    # in this encoding the end mark's one character is the id's two bytes
    rows.select(body.alias("value")).write.option("encoding", "UTF-16LE").option("lineSep", chr(end)).option("maxRecordsPerFile", FILE_DOCS).text(folder)


def token_files(spark, folder: str) -> DataFrame:
    """(stream, file_no, content) of what write_token_files wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    stream = F.regexp_extract("path", NAME, 1).cast("long")
    return files.select(stream.alias("stream"), F.coalesce(F.expr(f"try_cast(regexp_extract(path, r'{NAME}', 2) as int)"), F.lit(0)).alias("file_no"), "content")


def scan_blocks(files: DataFrame, end: int = END_MARK, block: int = BLOCK) -> DataFrame:
    """(stream, file_no, block_no, n_ids, ends): ends are places of separators in the block."""

    def run(batches):
        for batch in batches:
            for stream, file_no, content in zip(*(batch.column(i) for i in range(3))):
                ids = np.frombuffer(content.as_buffer(), "<u2", count=len(content.as_buffer()) // 2)
                for k in range(0, len(ids), block):
                    part = ids[k : k + block]
                    ends = pa.array([np.flatnonzero(part == end).astype(np.int32)], pa.list_(pa.int32()))
                    one = [pa.array([stream.as_py()], pa.int64()), pa.array([file_no.as_py()], pa.int32()), pa.array([k // block], pa.int32()), pa.array([len(part)], pa.int64()), ends]
                    yield pa.RecordBatch.from_arrays(one, names=["stream", "file_no", "block_no", "n_ids", "ends"])

    return files.mapInArrow(run, "stream long, file_no int, block_no int, n_ids long, ends array<int>")


def documents_of(blocks: DataFrame) -> DataFrame:
    """(stream, doc_no, start, n_tokens, ended), doc_no from 0 in each stream."""
    order = W.partitionBy("stream").orderBy("file_no", "block_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    at = blocks.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    at = at.withColumn("last_end", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
    at = at.withColumns(
        {
            "open": F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)),
            "docs_before": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
            "final": F.lead("block_no").over(order).isNull(),
        }
    )
    start = lambda i: F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", i - 1) + 1)
    made = lambda i, n, ended: F.struct((F.col("docs_before") + i).alias("doc_no"), start(i).cast("long").alias("start"), n.cast("long").alias("n_tokens"), F.lit(ended).alias("ended"))
    whole = F.transform("ends", lambda e, i: made(i, F.col("base") + e - start(i), True))
    k = F.size("ends")
    rest = F.col("base") + F.col("n_ids") - start(k)
    tail = F.when(F.col("final") & (rest > 0), F.array(made(k, rest, False))).otherwise(F.filter(whole, lambda _: F.lit(False)))
    return at.select("stream", F.inline(F.concat(whole, tail)))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, stream, start for every document: writes all documents as token files,
    counts them from the files alone, and names them by their order in the scan that both the
    writer and this query read."""
    docs = table(spark, sf_dir, "documents")
    folder = new_dir(spark, "tokens")
    write_token_files(docs, folder)
    counts = documents_of(scan_blocks(token_files(spark, folder)))
    at = F.monotonically_increasing_id()
    names = docs.select("doc_id", at.alias("at")).select("doc_id", F.shiftright("at", 33).alias("stream"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("doc_no"))
    both = names.join(counts, ["stream", "doc_no"], "full_outer")
    same = (F.col("n_tokens").isNotNull() & F.col("ended")).alias("same")
    checked = F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("the token files do not match the documents")).cast("long"))
    return both.select("doc_id", checked.alias("n_tokens"), "stream", "start")
