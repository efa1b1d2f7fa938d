"""Token ids as ORC files in ascending document order, and reading them back.

Texts are range-partitioned by document id (ties by a hash of the text), sorted, encoded and
written by Spark's ORC writer, one file per range.  ORC keeps the ids of each stripe in its
integer run-length encoding.  Row indexes hold minima and maxima per ``row_index_stride``
rows, and Bloom filters on the document id let a point lookup skip stripes.  Each row also
carries its file's number and its offset inside the file, so readers work stripe by stripe:
a document's position in the whole corpus is the file's base (a sum over one small number
per file) plus that offset, whichever split reads it.

Shuffling texts instead of ids keeps the exchange at about the compressed size of the
input, and the sampling pass of the range partitioning encodes nothing.

Defined results: a null text is empty (its row holds the end id alone); rows with equal ids
follow one another, ties by text; null ids come first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.tokens import text_encoder, text_slices

STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
_SCHEMA = "doc_id long, file_no int, file_start long, n_tokens long, ids array<int>"


def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = STRIPE_BYTES,
    row_index_stride: int = ROW_INDEX_STRIDE,
) -> str:
    """Write (doc_id, file_no, file_start, n_tokens, ids) as ORC in ascending id order."""
    import numpy as np
    import pyarrow as pa

    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        from pyspark import TaskContext

        encoder, file_no, start = text_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for lo, part in text_slices(texts):
                ids = [x + end for x in encoder.encode(part)]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                flat = pa.py_buffer(b"".join(ids))
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, flat])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(part)),
                        pa.array(np.full(len(part), file_no, dtype=np.int32)),
                        pa.array(start + ends - sizes),
                        pa.array(sizes),
                        lists,
                    ],
                    ["doc_id", "file_no", "file_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    ordered = (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        )
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    (
        ordered.select("doc_id", "text")
        .mapInArrow(encode, _SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    return path


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as stored, start over the whole corpus.

    A filter on doc_id reaches the ORC reader (row indexes and Bloom filters).  The bases
    come from the two small columns alone; they have one row per file and are broadcast.
    """
    stored = spark.read.schema(_SCHEMA).orc(path)
    from pyspark.sql import Window

    sizes = stored.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(bases), "file_no").select(
        "doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids"
    )


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): checksum of the ids as little-endian unsigned
    32-bit integers, taken from the Arrow buffers without unpacking the lists."""
    import pyarrow as pa

    def digest(batches):
        from zlib import crc32

        for batch in batches:
            lists = batch.column("ids")
            values = memoryview(lists.flatten().to_numpy().astype("<i4", copy=False).tobytes())
            at = lists.offsets.to_pylist()
            base = at[0] if at else 0
            sums = [crc32(values[4 * (a - base) : 4 * (b - base)]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
