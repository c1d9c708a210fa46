"""Alignment of tokenizers against a brute force over whole texts and all pairs of byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigspark.llm import alignment as m

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FRAGMENTS = ["hello", "World", "  ", " ", "\n", "\t", "don't", "123", "naïve", "日本語", "<|endoftext|>", "<0x41>", "<s>", "▁", "\x1c", "　", "é", "\U0001f642", "...", "\r\n", "\x00", "​", "x" * 40]


def spans(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + sizes[i]))
        at += sizes[i]
    return out


def brute(rows):
    """{row: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)} with all pairs of ranges compared."""
    pair = m.Pair(A, B)
    linked, found, total = {}, {}, Counter()
    for k, (_, text) in enumerate(rows):
        a, b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
            a, b = [], []
        sa, sb = spans(a, pair.size_a), spans(b, pair.size_b)
        linked[k] = [(y[0], x[0]) for x in sa for y in sb if x[1] < y[2] and y[1] < x[2]]
        total.update(linked[k])
        cuts = sorted({x[2] for x in sa} & {y[2] for y in sb})
        groups = [",".join(str(x[0]) for x in sa if lo < x[2] <= hi) + "|" + ",".join(str(y[0]) for y in sb if lo < y[2] <= hi) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found[k] = (len(a), len(b), len(groups), len(linked[k]), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
    top = {}
    for (b, _), n in total.items():
        top[b] = max(top.get(b, 0), n)
    return {k: (*v[:4], sum(total[p] == top[p[0]] for p in linked[k]), sum(total[p] for p in linked[k]), v[4]) for k, v in found.items()}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = [(i, "".join(draw.choice(FRAGMENTS) + draw.choice(["", " ", " "]) for _ in range(draw.randint(1, 12)))) for i in range(120)]
    out += [(200 + i, " ".join(draw.choice(["the", "cat", "sat", "on", "unbelievable", "mats,"]) for _ in range(60))) for i in range(60)]
    return [*out, (300, None), (301, ""), (302, " "), (303, "a▁b"), (200, out[120][1]), (200, "another text"), (None, "without an id"), (304, "café " * 30), (305, "漢" * 60)]


def check(got, rows):
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got], key=key) == sorted([(rows[k][0], *v) for k, v in want.items()], key=key)


def test_equals_brute_force_with_nulls_repeats_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, stripe string, batch int").repartition(3)
    check(m.align(docs, A, B).collect(), rows)


def test_small_batches_memos_salts_and_sums(spark, rows, monkeypatch):
    for name, value in (("BATCH_CHARS", 500), ("MEMO_CHUNKS", 40), ("PAIRS", 50), ("SALT_BATCHES", 10)):
        monkeypatch.setattr(m, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(m)  # workers take the small sizes too
    try:
        check(m.align(docs, A, B).collect(), rows)
    finally:
        cloudpickle.unregister_pickle_by_value(m)


def test_empty_table(spark):
    assert m.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_best_pairs(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog")], "doc_id long, text string")
    pair = m.Pair(A, B)
    counts = m.pair_counts(m.links(docs, A, B), len(pair.bytes_a), len(pair.bytes_b))
    best = {r.b_id: (r.a_id, r.n_links) for r in m.best_pairs(counts).collect()}
    the_a, the_b = pair.a.encode(" the").ids, pair.b.encode("the")
    assert len(the_a) == len(the_b) == 1 and best[the_b[0]] == (the_a[0], 2)


def test_counts_cover_repeats_in_one_text(spark):
    got = m.align(spark.createDataFrame([(1, "the the the"), (2, "the")], "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    assert [(r.n_links, r.n_best, r.count_sum) for r in got] == [(3, 3, 12), (1, 1, 4)]


def test_stored_batches_are_read_a_few_at_a_time(spark):
    """A group of rows is what a task holds when it writes or reads: it must not be a hundred rows of megabytes."""
    import glob

    import pyarrow.parquet as pq
    from sigspark.llm._shared import discard, store

    rows = spark.range(6, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.xxhash64("id", i)).alias("pair"))
    table = store(rows, "large", large=True)
    (file,) = glob.glob(table.stored_at.removeprefix("file://") + "/*.parquet")
    assert pq.ParquetFile(file).num_row_groups >= 2 and table.count() == 6
    discard(table)
