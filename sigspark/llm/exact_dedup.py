"""Exact dedup by skew-safe combining: local, salted and global stages, each comparing full content.

Texts are equal when they are identical after ASCII white space is deleted. The content travels as the
zstd frame of the normalised UTF-8 bytes: one level and one library make equal bytes equal frames, and a
frame decompresses to one text only, so grouping by the frame compares full content.

Defined results: null text counts as empty; the empty text is an ordinary content; a null doc_id ranks behind
every other id; rows that repeat (same doc_id, same length, equal texts) get the same flags; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

#: Salts of a digest in the second stage; the third stage sees at most so many rows of one content.
SALTS = 32
_DROP = bytes(range(9, 14)) + b" "
_ID = "cast(9223372036854775808 as decimal(38,0))"
_STEP = "cast(36893488147419103232 as decimal(38,0))"


def _digests(with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            out: dict[str, list] = {"digest": [], "guard": [], "n_chars": []}
            content = []
            for text in b.column("text").to_pylist():
                text = text or ""
                norm = text.encode().translate(None, _DROP)
                out["digest"].append(hashlib.sha256(norm).digest())
                out["guard"].append(xxhash.xxh64_intdigest(norm) - 2**63)
                out["n_chars"].append(len(text))
                if with_content:
                    content.append(pack(norm))
            cols = [b.column("doc_id"), pa.array(out["digest"], pa.binary()), pa.array(out["guard"], pa.int64()), pa.array(out["n_chars"], pa.int64())]
            names = ["doc_id", "digest", "guard", "n_chars"]
            if with_content:
                cols, names = [*cols, pa.array(content, pa.binary())], [*names, "content"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct content: digest, guard, group_size, keep_id and keep_chars of the row that stays.

    The first hash aggregate is partial within each input partition (local dedup, without a shuffle); its groups are
    merged by (digest, salt, content), where the salt is the input partition, and the salt winners by (digest, content).
    A content therefore sends at most one row per input partition, spread over SALTS tasks, and then SALTS rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(True), "doc_id long, digest binary, guard long, n_chars long, content binary")
    # (most code points, smallest id) as one number, so that the aggregate keeps a fixed-width buffer
    rank = F.expr(f"cast(n_chars as decimal(38,0)) * {_STEP} + coalesce({_ID} - cast(doc_id as decimal(38,0)), 0)").cast("decimal(38,0)")
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("digest", "guard", "salt", "content").agg(F.count("*").alias("n"), F.max(rank).alias("best"))
    merged = salted.groupBy("digest", "guard", "content").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    return merged.select(
        "digest",
        "guard",
        "group_size",
        F.expr(f"cast(if(best % {_STEP} = 0, null, {_ID} - best % {_STEP}) as long)").alias("keep_id"),
        F.expr(f"cast((best - best % {_STEP}) / {_STEP} as long)").alias("keep_chars"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    groups = duplicate_groups(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(False), "doc_id long, digest binary, guard long, n_chars long")
    return rows.join(groups, ["digest", "guard"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
