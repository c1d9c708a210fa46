"""Near-duplicate groups by MinHash: universal hash minima, banding, signature verification, connected components.

Texts with the same shingle set are one vertex, so copies never meet in a bucket. In a bucket, every vertex is paired
with the bucket's smallest one (a star). Once the confirmed links are merged into components, only buckets that still hold several
are searched on, block against block: every vertex outside the bucket's largest component against all its vertices. That
yields groups of components whose signatures agree somewhere, and in these groups, again block against block, pairs of different
components are compared in full until they are linked or no pair is left. So no link between components is lost to the
star, each block hands on at most one row per vertex, and groups of copies never become all their pairs.

A pair is a candidate if a band of its signatures is equal. Bands and the signature check follow from the threshold (`plan`): pairs
at it are missed with a probability of at most MISS_BAND by the bands, and MISS_CHECK by the check. Links are confirmed on the full sets.

Vertices are named by numbers of their own, so rows of one doc_id with different texts are different vertices; only at the end does a
component take the smallest doc_id of its rows.

Defined results: a text without words, null or empty, has no shingles and is linked with nothing, and so is a row without doc_id; rows that
repeat share a component; of rows of one doc_id with different texts, each has the component of its own text; very long texts are compared whole;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, small_batches, store
from .components import components
from .words import mixed, shingles, text_word_hashes

MINIMA = 128
MISS_BAND, MISS_CHECK = 4.5e-7, 2.5e-7
#: Vertices of a group that meet as many others in one task, and their shingles at most.
BLOCK_ROWS = 4000
BLOCK_SHINGLES = 8_000_000
#: Shingles that a task remembers while it compares sets.
CACHE_SHINGLES = 4_000_000
_U = np.uint64
_rng = np.random.default_rng(85)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * _U(2) + _rng.integers(0, 2, MINIMA, dtype=np.uint64)


class Plan(NamedTuple):
    """Bands of so many rows of the signature, and how many of all minima agree at least."""

    bands: int
    rows: int
    agree: int


def plan(percent: int) -> Plan:
    """The widest bands, and the strictest check, that lose no more than MISS_BAND and MISS_CHECK of the pairs at the threshold."""
    p = min(percent, 99) / 100
    needed = {r: ceil(log(MISS_BAND) / log1p(-(p**r))) for r in range(1, MINIMA + 1)}
    rows = max((r for r, bands in needed.items() if bands * r <= MINIMA), default=0)
    if not rows:
        raise ValueError(f"{MINIMA} minima cannot find pairs at {percent} percent")
    agree, missed = 0, (1 - p) ** MINIMA
    while missed <= MISS_CHECK:
        agree += 1
        missed += comb(MINIMA, agree) * p**agree * (1 - p) ** (MINIMA - agree)
    return Plan(needed[rows], rows, agree)


def signature(sets: np.ndarray) -> np.ndarray:
    """Minima of MINIMA multiply-add-shift hashes, universal over 32-bit keys."""
    x, low = sets >> _U(32), np.full(MINIMA, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * _A + _B).min(axis=0), out=low)
    return (low >> _U(32)).astype("<u4")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        n, hi, lo, sig = [], [], [], []
        for words in text_word_hashes(b.column("text").to_pylist()):
            s = shingles(words)
            n.append(len(s))
            a, z = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
            hi.append(int(a))
            lo.append(int(z))
            sig.append(signature(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary()), b.column("mark")], names=["doc_id", "n", "hi", "lo", "sig", "mark"])


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if hasattr(column, "to_pylist") else column), dtype="<u4").reshape(-1, MINIMA)


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b.column("sig")).astype(np.uint64)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands))
            for i in range(rows):
                h = mixed(h * _U(0xD6E8FEB86659FD93) + sig[:, i : bands * rows : rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("rep")), bands)), pa.array(h.ravel().view(np.int64))], names=["rep", "key"])

    return run


def _agreeing(agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_signatures(b.column("sig_a")) == _signatures(b.column("sig_b"))).sum(axis=1) >= agree
            yield b.select(["a", "b"]).filter(pa.array(same))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([pack((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["rep", "packed"])


class FullSets:
    """Shingle sets of packed texts, remembered up to CACHE_SHINGLES."""

    def __init__(self):
        import zstandard

        self.unpack, self.known, self.size = zstandard.ZstdDecompressor().decompress, {}, 0

    def __call__(self, packed: bytes) -> np.ndarray:
        found = self.known.get(packed)
        if found is None:
            found = shingles(next(text_word_hashes([self.unpack(packed).decode()])))
            if self.size > CACHE_SHINGLES:
                self.known.clear()
                self.size = 0
            self.known[packed] = found
            self.size += len(found)
        return found


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = FullSets()
        for b in batches:
            ok = [linked(full(x), full(y), percent) for x, y in zip(b.column("packed_a").to_pylist(), b.column("packed_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class Merged:
    """Which of the components of a block have been merged so far."""

    def __init__(self, comps):
        self.up = {c: c for c in comps}

    def root(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = c = self.up[self.up[c]]
        return c


def _block(block: pd.DataFrame, agree: int, linked) -> pd.DataFrame:
    """Pairs of a query and a member that merge components of the block: their signatures agree, and linked(query row, member row) holds."""
    q, m = block[block["query"]], block[~block["query"]]
    out: list[tuple[int, int]] = []
    if len(q) and len(m):
        merged, names, index = Merged(set(block["comp"])), m["comp"].to_numpy(), np.arange(len(m))
        base, rep = _signatures(m["sig"]), m["rep"].to_numpy()
        for i, (r, c, s) in enumerate(zip(q["rep"], q["comp"], _signatures(q["sig"]), strict=True)):
            same = (base == s).sum(axis=1)
            near = index[(same >= agree) & (names != c)]
            for k in near[np.argsort(-same[near], kind="stable")]:
                x, y = merged.root(c), merged.root(names[k])
                if x != y and linked(i, k):
                    merged.up[max(x, y)] = min(x, y)
                    out.append((min(r, rep[k]), max(r, rep[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _agreeing_block(agree: int):
    return lambda block: _block(block, agree, lambda i, k: True)


def _linked_block(agree: int, percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        full = FullSets()
        q, m = block.loc[block["query"], "packed"].to_list(), block.loc[~block["query"], "packed"].to_list()
        return _block(block, agree, lambda i, k: linked(full(q[i]), full(m[k]), percent))

    return run


def _blocks(known: DataFrame, weight: str) -> DataFrame:
    """(key, i, j, rep, comp, query): in groups by key that hold several components, block i of all members beside block j of those outside the largest component.

    weight is a column of known: blocks have about BLOCK_ROWS members of weight 1.
    """
    sizes = known.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    # the largest component as one number beside its size: an aggregate with a fixed-width buffer
    top = F.max(F.expr("cast(n as decimal(38,0)) * 36893488147419103232 + (cast(comp as decimal(38,0)) + 9223372036854775808)"))
    open_ = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("w").alias("w"), top.alias("top")).where("comps > 1")
    open_ = open_.select("key", F.expr(f"cast(ceil(w / {BLOCK_ROWS}) as long)").alias("blocks"), F.expr("cast(top % 36893488147419103232 - 9223372036854775808 as long)").alias("main"))
    rows = known.join(open_, "key").withColumn("mine", F.expr("pmod(xxhash64(rep), blocks)"))
    base = rows.select("key", "rep", "comp", F.col("mine").alias("i"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"), F.lit(False).alias("query"))
    asks = rows.where("comp <> main").select("key", "rep", "comp", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("i"), F.col("mine").alias("j"), F.lit(True).alias("query"))
    asked = asks.select("key", "j").distinct()
    columns = ["key", "i", "j", "rep", "comp", "query"]
    return base.join(asked, ["key", "j"], "left_semi").select(*columns).unionByName(asks.select(*columns))


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text by which rows of one doc_id are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, mark, n_shingles, component_id, kept."""
    bands, rows_of_band, agreeing = plan(percent)
    small_batches(docs.sparkSession)
    slim = _slim(docs)
    signed = store(slim.mapInArrow(_signed, "doc_id long, n long, hi long, lo long, sig binary, mark long"), "near-signatures")
    vertices = signed.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.first("sig").alias("sig"), F.first("n").alias("size"))
    # unique numbers, fixed by the table that holds them
    reps = store(vertices.select(F.monotonically_increasing_id().alias("rep"), "hi", "lo", "row.doc_id", "row.mark", "sig", "size"), "near-vertices")
    buckets = reps.select("rep", "sig").mapInArrow(_bands(bands, rows_of_band), "rep long, key long")
    shared = buckets.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = store(buckets.join(shared, "key"), "near-buckets")
    # texts of the vertices that share a bucket: joined as they are, and packed then
    meeting = reps.select("rep", "doc_id", "mark").join(members.select("rep").distinct(), "rep", "left_semi")
    needed = slim.where("doc_id is not null").join(meeting, ["doc_id", "mark"]).select("rep", "text")
    texts = store(needed.mapInArrow(_packed, "rep long, packed binary").groupBy("rep").agg(F.max("packed").alias("packed")), "near-texts")

    star = members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    a, b = (reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    agree = star.join(a, "a").join(b, "b").mapInArrow(_agreeing(agreeing), "a long, b long")
    a, b = (texts.select(F.col("rep").alias(x), F.col("packed").alias(f"packed_{x}")) for x in "ab")
    links = store(agree.join(a, "a").join(b, "b").mapInArrow(_confirmed(percent), "a long, b long"), "near-links")
    labels = components(links)
    # buckets that hold several components: which components agree
    known = members.join(labels, members["rep"] == labels["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"), F.lit(1).alias("one"))
    agree = store(_blocks(known, "one").join(reps.select("rep", "sig"), "rep").groupBy("key", "i", "j").applyInPandas(_agreeing_block(agreeing), "a long, b long").distinct(), "near-open")
    discard(members)
    if not agree.isEmpty():
        comp_of = lambda x: agree.join(labels, agree[x] == labels["node"], "left").select("a", "b", F.coalesce("component", x).alias(f"comp_{x}"))
        of_b = comp_of("b")
        pairs = comp_of("a").join(of_b, ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
        groups = components(pairs).select(F.col("node").alias("comp"), F.col("component").alias("key"))
        alone = groups.join(labels, groups["comp"] == labels["component"], "left_anti").select(F.col("comp").alias("rep"), "comp", "key")
        inside = labels.join(groups, labels["component"] == groups["comp"]).select(F.col("node").alias("rep"), "comp", "key")
        known = store(inside.unionByName(alone).join(reps.select("rep", "size"), "rep").select("key", "rep", "comp", F.expr(f"1 + size div {BLOCK_SHINGLES // BLOCK_ROWS}").alias("weight")), "near-groups")
        rows = _blocks(known, "weight").join(reps.select("rep", "sig"), "rep").join(texts, "rep")
        more = store(rows.groupBy("key", "i", "j").applyInPandas(_linked_block(agreeing, percent), "a long, b long").distinct(), "near-links")
        discard(known)
        labels = components(links.union(more))
    discard(texts)
    first = reps.select("rep", F.col("doc_id").alias("first"))
    named = labels.join(first, labels["node"] == first["rep"]).groupBy("component").agg(F.min("first").alias("component_id"))
    linked_ = labels.join(named, "component").select(F.col("node").alias("rep"), "component_id")
    vertex = reps.select("rep", "hi", "lo", "doc_id").join(linked_, "rep", "left").select("hi", "lo", F.coalesce("component_id", "doc_id").alias("component"))
    rows = signed.select("doc_id", "mark", "n", "hi", "lo").join(vertex, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
    return rows.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows are linked when 100 * |A and B| >= percent * |A or B| for their sets of five-word shingles.
    """
    return labelled(docs, percent).drop("mark")


def without_near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of docs, all columns, whose doc_id names their component; rows without doc_id, which no group can name, stay."""
    dropped = labelled(docs, percent).where(~F.col("kept")).select("doc_id", "mark").distinct()
    return docs.join(dropped, (docs["doc_id"].cast("long") == dropped["doc_id"]) & (F.xxhash64(docs["text"]) == dropped["mark"]), "left_anti")
