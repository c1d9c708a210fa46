import random
import re

import numpy as np
from pyspark.sql.functions import lit

from sigspark.llm.components import components
from sigspark.llm.near_dedup import near_duplicates, plan
from sigspark.llm.stages import near_dedup
from sigspark.llm.words import NOT_WORD, WHITE, text_word_hashes

DOCS = "doc_id long, text string, component_id string, n int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[a] = up[b] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)], least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_matches_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, base = [], [rnd.choices(vocabulary, k=n) for n in (3, 5, 9, 40, 80, 120, 300)]
    for i in range(160):  # chains of edits, so that groups hang together by links that the star does not see
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            base[rnd.randrange(3, 7)] = w
        rows.append((i + 10, (" " if i % 2 else "\n\t").join(w).upper() if i % 3 else "  " + " ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two three"), (5, "one TWO three"), (6, "É é"), (7, "é é")]
    got = near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(6))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (9, "a b c d e f g"), (None, "a b c d e f g")]
    got = near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS))
    assert sorted(map(tuple, got.collect()), key=str) == [(5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False), (None, 3, None, True)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_rows_of_one_doc_id_with_different_texts(spark):
    rnd = random.Random(5)
    a, b, c = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(60)) for _ in range(3))
    rows = [(3, a), (5, a + " more"), (5, b), (7, b + " more"), (7, c), (8, c), (2, a + " too"), (2, "alone")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).withColumns({"mark": lit(1), "_dropped": lit(2)})
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)
    left = near_dedup(spark, docs, "")
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(2, a + " too"), (2, "alone"), (5, b), (7, c)])


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_word_hashes_do_not_depend_on_the_batch():
    long = "Ab é, x1 " * 300_000 + "y" * 1_200_000 + " z"
    texts = ["", None, "Ab é, x1", long, "z ab"]
    for separator, pattern in ((WHITE, r"[^\x20\x09-\x0D]+"), (NOT_WORD, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        known = {}
        for t, h in zip(texts, text_word_hashes(texts, separator), strict=True):
            words = re.findall(pattern, lowered(t))
            assert len(words) == len(h)
            for w, x in zip(words, h.tolist(), strict=True):
                assert known.setdefault(w, x) == x
        assert len(set(known.values())) == len(known)
        assert [len(x) for x in (np.concatenate([*text_word_hashes([long], separator)]),)] == [len(re.findall(pattern, long))]


def test_bands_and_check_hold_their_bounds_at_lower_thresholds():
    assert plan(85) == (25, 5, 86) and plan(80) == (28, 4, 78)


def test_the_near_dedup_stage_links_from_80_percent(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(0, 40, 2):
        w = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:50] + ["new"] + w[51:80] + ["new"] + w[81:]))]  # 86 of 106 shingles: 0.81
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    both = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert 0.80 <= len(both[0] & both[1]) / len(both[0] | both[1]) < 0.85
    assert {r.doc_id for r in near_dedup(spark, docs, "").collect()} == set(range(0, 40, 2))
