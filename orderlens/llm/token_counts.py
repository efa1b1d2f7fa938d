"""Token counts of whole texts; huge documents are counted in parallel by overlap
resynchronisation.

Documents of up to ``chunk_chars`` characters are counted in place, without a shuffle.
Longer ones are cut into windows that overlap their neighbours.  The windows are dealt to
all tasks and encoded with offsets.  Two neighbouring windows are spliced at a common
pre-token start inside their overlap.  Such a position is proven stable:

* pre-tokenization reads left to right and never looks back, so once the right window
  starts a pre-token where the whole text starts one, both go on alike;
* an alternative of the pattern looks at most one character beyond its end, so a boundary
  at least ``margin`` characters before the left window's end is not caused by the cut;
* ``margin`` exceeds the longest special token, so no special token that decides the
  boundary is cut by either window's edge.

When a seam has no common boundary (one word longer than the overlap, for example), its
document goes to the next round with a doubled stride and an eight-fold overlap.  The
stride outgrows every text in the end, which leaves a single window, so the count is exact.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are counted one by
one, so repeated rows and repeated or null ids give a row each; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.tokens import load_tokenizer, text_encoder, text_slices
from orderlens.session import checkpoint_table

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512

_WINDOW = "row_no long, k long, at long, n_chars long, body string"
_ENCODED = (
    "row_no long, k long, total long, left_pos array<long>, left_cum array<long>, "
    "right_pos array<long>, right_cum array<long>"
)


def seam_margin(tokenizer) -> int:
    """Characters between a usable boundary and a window's edge."""
    return 2 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def boundaries(tokenizer, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Token count of a text, and (character position, tokens before) of its pre-tokens."""
    enc = tokenizer.encode(text, add_special_tokens=False)
    words, offsets = enc.word_ids, enc.offsets
    starts = [(offsets[i][0], i) for i in range(len(words)) if i == 0 or words[i] != words[i - 1]]
    return len(words), starts


def _cut(stride: int, overlap: int):
    import pyarrow as pa

    def windows(batches):
        for batch in batches:
            for row_no, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n = len(text)
                rows: list[tuple] = []
                for k, lo in enumerate(range(0, n, stride)):
                    at, end = max(0, lo - overlap), min(n, lo + stride + overlap)
                    rows.append((row_no, k, at, n, text[at:end]))
                    if len(rows) == 64 or lo + stride >= n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])],
                            ["row_no", "k", "at", "n_chars", "body"],
                        )
                        rows = []

    return windows


def _encode(path: str, stride: int, overlap: int):
    import pyarrow as pa

    def encode(batches):
        tok = load_tokenizer(path)
        margin = seam_margin(tok)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                total, starts = boundaries(tok, r["body"])
                at, end = r["at"], r["at"] + len(r["body"])
                lo, hi = r["k"] * stride, (r["k"] + 1) * stride
                left = [(at + p, c) for p, c in starts if r["k"] and at + margin <= at + p <= lo + overlap - margin]
                right = [(at + p, c) for p, c in starts if end < r["n_chars"] or hi < r["n_chars"]]
                right = [(p, c) for p, c in right if hi - overlap + margin <= p <= end - margin]
                out.append(
                    (r["row_no"], r["k"], total, [p for p, _ in left], [c for _, c in left],
                     [p for p, _ in right], [c for _, c in right])
                )
            if out:
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4
                names = ["row_no", "k", "total", "left_pos", "left_cum", "right_pos", "right_cum"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return encode


def splice_windows(encoded: DataFrame) -> DataFrame:
    """(row_no, n_tokens, n_windows): windows of a text joined at their common boundaries;
    n_tokens is null when a seam has none.  Only boundary lists of overlaps are shuffled."""
    w = Window.partitionBy("row_no").orderBy("k")
    seams = (
        encoded.withColumn("next_pos", F.lead("left_pos").over(w))
        .withColumn("next_cum", F.lead("left_cum").over(w))
        .withColumn("p", F.get(F.array_intersect("right_pos", "next_pos"), F.lit(0)))
        .withColumn(
            "part",
            F.expr(
                "CASE WHEN next_pos IS NULL THEN total ELSE "
                "get(right_cum, CAST(array_position(right_pos, p) AS INT) - 1) - "
                "get(next_cum, CAST(array_position(next_pos, p) AS INT) - 1) END"
            ),
        )
    )
    return seams.groupBy("row_no").agg(
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def count_long(texts: DataFrame, tokenizer_path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(row_no, n_tokens, n_windows) of the long texts in (row_no, text)."""
    done: list[DataFrame] = []
    stride, rest = chunk_chars, texts
    while True:
        spark = rest.sparkSession
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        windows = rest.mapInArrow(_cut(stride, overlap), _WINDOW).repartition(tasks, "row_no", "k")
        counted = checkpoint_table(
            splice_windows(windows.mapInArrow(_encode(tokenizer_path, stride, overlap), _ENCODED)),
            "token-counts",
        )
        done.append(counted.filter("n_tokens IS NOT NULL"))
        failed = counted.filter("n_tokens IS NULL").select("row_no")
        if failed.isEmpty():
            break
        rest = rest.join(failed, "row_no", "left_semi")
        stride, overlap = 2 * stride, min(8 * overlap, stride // 2)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    limit: int = 1024,
) -> DataFrame:
    """One row per input row: (id, n_bytes, n_tokens, over_limit, n_windows)."""
    import pyarrow as pa

    if not 64 <= overlap <= chunk_chars // 4:
        raise ValueError("overlap must lie between 64 and a quarter of chunk_chars")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.length("text")

    def count(batches):
        encoder = text_encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column("text")
            n = [c for _, part in text_slices(texts) for c in encoder.count(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([1] * len(n), pa.int64())],
                ["id", "n_bytes", "n_tokens", "n_windows"],
            )

    id_type = base.schema["id"].dataType.simpleString()
    short = (
        base.filter(size <= chunk_chars)
        .select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
        .mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, n_windows long")
    )
    long_docs = checkpoint_table(
        base.filter(size > chunk_chars).withColumn("row_no", F.monotonically_increasing_id()), "long-docs"
    )
    counted = count_long(long_docs.select("row_no", "text"), tokenizer_path, chunk_chars, overlap)
    spliced = long_docs.select("row_no", "id", F.octet_length("text").cast("long").alias("n_bytes")).join(counted, "row_no")
    return short.unionByName(spliced.select("id", "n_bytes", "n_tokens", "n_windows")).select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        "n_windows",
    )
