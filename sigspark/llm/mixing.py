"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources, sorted by code point with null last, get targets (`targets`), and equal blocks of BLOCK_WORDS words are
allotted to them by highest quotients. A source is dealt into shards of about SHARD_WORDS words by a hash of the
document, and its blocks are apportioned to its shards in the same way. In a shard, documents stand in a seeded
order and are cut into blocks; the shard is taken as often as its quota has whole passes, then its first blocks.

Defined results: null text has size 0; a source without words has target 0; an empty table gives an empty result;
rows that repeat are separate rows, and rows of one doc_id stand in the order of hashes of their texts, so reruns agree; very long texts are
cut by words only where the mix ends in them. Only the totals of sources (a configuration-sized dimension, at most
MAX_SOURCES) reach the driver.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE, n_words, row_schema, small_batches

BLOCK_WORDS = 32
SHARD_WORDS = 4_000_000
MAX_REPEATS = 3
MAX_SOURCES = 100_000
SEED = 17
WEIGHTS = (1.0, 2.0, 3.0)


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: int = MAX_REPEATS) -> list[float]:
    """Shares total by weight; a source stops at `repeats` times its size, and its excess is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= repeats * sizes[i]]
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else unit * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """Seats by highest quotients w / (2k + 1); ties go to the earlier entry."""
    w = np.asarray(weights, dtype=float)
    if seats <= 0 or not len(w) or w.sum() <= 0:
        return np.zeros(len(w), dtype=np.int64)
    # rounding at any divisor is a state of the method; from there, seats are added or removed one by one
    k = np.floor(w * (seats / w.sum()) + 0.5).astype(np.int64)
    more = int(k.sum()) < seats
    heap = [(-(w[i] / (2 * k[i] + 1)), i) if more else (w[i] / (2 * k[i] - 1), -i) for i in range(len(w)) if w[i] > 0 and (more or k[i] > 0)]
    heapq.heapify(heap)
    for _ in range(abs(seats - int(k.sum()))):
        _, i = heapq.heappop(heap)
        i = abs(i)
        k[i] += 1 if more else -1
        if more or k[i] > 0:
            heapq.heappush(heap, (-(w[i] / (2 * k[i] + 1)), i) if more else (w[i] / (2 * k[i] - 1), -i))
    return k


def _shard_quotas(cells: pd.DataFrame) -> pd.DataFrame:
    cells = cells.sort_values("_shard", ignore_index=True)
    cells["_quota"] = sainte_lague(cells["_words"], int(cells["_seats"].iloc[0]))
    return cells[["_source", "_shard", "_words", "_quota"]]


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs with _size, _source_size, _target and _taken (words that the mix takes, repeats counted).

    weights repeat over the sorted sources. docs needs doc_id, source and text, or _size and _mark (a hash of the text, by which rows of one doc_id are
    told apart). One shuffle of the rows, by shard.
    """
    spark = docs.sparkSession
    if "_mark" not in docs.columns:
        docs = docs.withColumn("_mark", F.xxhash64("text"))
    if "_size" not in docs.columns:
        docs = docs.withColumn("_size", n_words(F.col("text")))
    totals = docs.groupBy("source").agg(F.sum("_size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r["size"]) for r in totals]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes))
    seats = sainte_lague(want, round(sum(want) / block_words))
    plan = spark.createDataFrame(
        [(r.source, i, sizes[i], want[i], int(seats[i]), max(1, -(-sizes[i] // shard_words))) for i, r in enumerate(totals)],
        "_name string, _source int, _source_size long, _target double, _seats long, _shards long",
    )
    rows = docs.join(plan, docs["source"].eqNullSafe(plan["_name"])).drop("_name").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_size", "_mark"), F.col("_shards")))
    cells = rows.groupBy("_source", "_shard", "_seats").agg(F.sum("_size").alias("_words"))
    quotas = cells.groupBy("_source").applyInPandas(_shard_quotas, "_source int, _shard long, _words long, _quota long")
    order = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_size", "_mark"), "doc_id", "_size", "_mark")
    upto = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(quotas, ["_source", "_shard"]).withColumn("_upto", upto)
    take = F.least(F.col("_quota") * block_words, F.col("_words") * MAX_REPEATS)
    passes = F.expr("cast(if(_words > 0, floor(_take / _words), 0) as long)")
    rows = rows.withColumn("_take", take).withColumn("_passes", passes)
    rest = F.col("_take") - F.col("_passes") * F.col("_words")
    last = F.greatest(F.lit(0), F.least(F.col("_upto"), rest) - (F.col("_upto") - F.col("_size")))
    rows = rows.withColumn("_taken", (F.col("_passes") * F.col("_size") + last).cast("long"))
    return rows.drop("_source", "_shard", "_seats", "_shards", "_mark", "_words", "_quota", "_upto", "_take", "_passes")


def mixture_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_mark"))
    return mix(slim).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (row, text, last) with texts cut after so many words as last says."""
    word = re.compile(f"[^{SPACE}]+")
    for b in batches:
        cut = []
        for text, n in zip(b.column("text").to_pylist(), b.column("last").to_pylist(), strict=True):
            end = next((m.end() for i, m in enumerate(word.finditer(text), 1) if i == n), 0)
            cut.append(text[:end])
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(cut, pa.string())], names=["row", "text"])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken; the last may hold its first words only."""
    small_batches(docs.sparkSession)
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # other columns may have any names
    rows = mix(docs.select(whole_row, "doc_id", "source", n_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_mark"))).where("_taken > 0")
    whole = rows.where("_taken >= _size").select("row", F.explode(F.expr("sequence(1L, _taken div _size)"))).select("row.*")
    part = rows.where("_taken % _size > 0").select("row", "row.text", F.expr("_taken % _size").alias("last"))
    cut = part.mapInArrow(_first_words, row_schema(part.schema["row"].dataType, "text string"))
    return whole.unionByName(cut.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns)))
