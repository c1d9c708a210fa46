import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm.words import NOT_WORD, text_sentences, text_word_hashes
from sigspark.llm.toxicity import PREFIXES, THRESHOLD, offending_sentences, toxicity, train, without_toxic

DOCS = "doc_id long, text string, score string, toxic int"


def corpus(n=600):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rnd.choices(words, k=rnd.randint(4, 12))) for _ in range(rnd.randint(1, 8))]
        bad = i % 4 == 0
        if bad:
            sentences[rnd.randrange(len(sentences))] += rnd.choice([" Vilething", " grawlix", " vileperson"])
        docs.append((i, ". ".join(sentences) + "!", "x", 1))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_documents_and_their_sentences(spark):
    rows, known = corpus()
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(known, "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    truth = dict(known)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in got)
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.score for r in toxicity(docs, labels).collect()} == {r.doc_id: r.score for r in got}
    found = offending_sentences(docs, train(docs, labels)).collect()
    assert sum(any(w in r.text.lower() for w in ("vile", "grawlix")) for r in found) >= 0.95 * len(found) > 0
    left = without_toxic(docs, labels)
    assert left.schema == docs.schema and left.count() == sum(not r.predicted for r in got)


def test_scores_match_brute_force(spark):
    rows, known = corpus(300)
    rows += [(1000, "Vilething " * 30_000, "x", 1), (1001, "É vile. Grawlix!\nw1 w2", "x", 1), (1002, "...", "x", 1)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(known, "doc_id long, toxic int")
    model = train(docs, labels)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))

    def feature(data):
        """The weight of a word or prefix, which is hashed as a text of its own."""
        return weight.get(int(next(text_word_hashes([data.decode("utf-8", "surrogateescape")], NOT_WORD))[0] >> np.uint64(42)), 0.0)

    got = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    for doc_id, text, *_ in rows[:40] + rows[-2:]:
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", sentence)]
            if words:
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(feature(w) for w in words) + sum(prefix(w, k, weight) for w in words for k in PREFIXES if len(w) > k))))
        assert got[doc_id] == pytest.approx(1 - clean, abs=1e-4)
    assert got[1000] == pytest.approx(1.0)


def prefix(word, k, weight):
    rows = next(text_sentences([word.decode()], NOT_WORD, None, (k,)))[0]
    return weight.get(int(rows[1] >> np.uint64(42)), 0.0)


def test_a_late_sentence_of_a_long_document_is_learnt_from(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(160):
        text = ". ".join(" ".join(rnd.choices(words, k=10)) for _ in range(200))
        docs.append((i, text + (". some Vilething here" if i % 4 == 0 else ""), "x", 1))
        labels.append((i, int(i % 4 == 0)))
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got) >= 0.9 * len(got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, known = corpus(200)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(known, "doc_id long, toxic int")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity(docs, x).collect()} for x in (labels, other))
    assert a == pytest.approx(b)


def test_nulls_empty_texts_and_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", None, None), (None, "a b", None, None), (3, "...", None, None), (3, "...", None, None)], DOCS)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity(docs, labels).collect()][:2] == [(0.0, 0)] * 2
    assert without_toxic(docs, labels).count() == 5
    assert all(r.score < 1e-9 for r in toxicity(docs, labels.limit(0)).collect())
    assert toxicity(docs.limit(0), labels).collect() == []
