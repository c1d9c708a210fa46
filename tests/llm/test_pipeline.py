from collections import Counter

import corpus_pipeline
from sigspark.llm import stages
from sigspark.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_follow_on_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "packing":
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(after)
        before = after
    toxic, lines, near, mixed, packed = kept
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in toxic.collect()} <= set(texts) and toxic.count() >= 0.8 * docs.count()
    assert lines.count() == toxic.count()
    assert all(set(r.text.split()) <= set(texts[r.doc_id].split()) for r in lines.collect())
    assert near.count() == near_duplicates(lines, stages.NEAR_PERCENT).where("kept").count() == near.select("doc_id").distinct().count()
    size = Counter()
    for r in mixed.collect():
        size[r.source] += len(r.text.split())
    whole = sum(len(r.text.split()) for r in near.collect())
    assert abs(sum(size.values()) - whole) <= 0.02 * whole
    assert sum(r.length for r in packed.collect()) > 0
    assert len({(r.doc_id, r.start) for r in packed.collect()}) <= packed.count()


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars int, row string, id int, keeper string, shared int, mark string, `_size` int, `a.b` string"


def test_stages_take_nulls_repeated_rows_long_texts_and_columns_of_any_name(spark, tmp_path):
    more = ("r", 1, "k", 2, "m", 3, "dot")
    texts = [(1, None), (2, ""), (3, "   \n"), (4, "one two three. four five\nsix"), (4, "one two three. four five\nsix"), (5, "another text of five words. " * 30), (5, "of the same id " * 30), (None, "no id at all"), (6, "word " * 60_000), (7, "é" * 5000)]
    rows = [(i, t, None if i == 2 else "en", None if i in (3, 4) else f"s{(i or 0) % 2}", None, *more) for i, t in texts]
    for docs in (spark.createDataFrame(rows, ODD), spark.createDataFrame(rows, ODD).limit(0)):
        empty, before = docs.isEmpty(), docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, SF)
            assert name == "packing" or after.columns == docs.columns
            path = f"{tmp_path}/{name}-{empty}"
            after.write.parquet(path)
            before = spark.read.parquet(path)
            assert before.isEmpty() == empty
            if name in ("toxicity", "line_dedup", "near_dedup"):
                assert before.count() == (0 if empty else len(rows))  # nothing here is toxic, and no two documents are alike
