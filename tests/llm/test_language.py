import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.llm.language import LANE, OVER, UNKNOWN, CrossParser, held_out, language_id, normalised, suffix_automaton

DOCS = "doc_id long, text string, lang string, score string"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=40).map(lambda b: bytes(c % 3 for c in b)), st.binary(max_size=8).map(lambda b: bytes(c % 3 for c in b)))
def test_automaton_accepts_substrings_only(data, part):
    step, state = suffix_automaton(data), 0
    for c in part:
        state = step[state].get(c, -1)
        if state < 0:
            break
    assert (state >= 0) == (part in data)


def greedy(sample, text):
    """Phrases of a whole text, by searching."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_phrase_counts_match_brute_force():
    rnd = random.Random(2)
    samples = tuple((f"l{k}", bytes(rnd.choices(b"abcd efg"[k : k + 5], k=400))) for k in range(3))
    texts = [bytes(rnd.choices(b"abcdefgh ", k=n)) for n in (0, 1, 3, LANE - 1, LANE, LANE + 1, LANE + OVER, LANE + OVER + 1, 5 * LANE + 7)]
    texts += [bytes(samples[1][1]) * 9, samples[0][1][3:300] * 20 + b"zz" + samples[2][1] * 4]  # phrases as long as the sample
    got = CrossParser(samples).phrases([np.frombuffer(t, dtype=np.uint8) for t in texts])
    assert [[greedy(s, t) for t in texts] for _, s in samples] == got.tolist()


def test_normalised():
    assert normalised("  A1b--É ß\n").tobytes() == "a b é ß ".encode()


def test_held_out_accuracy_and_edge_cases(spark):
    rnd = random.Random(3)
    words = {"xx": [a + b for a in "kltm" for b in ("ai", "oo", "ua")], "yy": [a + b for a in ("sch", "br", "zw") for b in "eiä"], "zz": ["δέλτα", "άλφα", "βήτα"]}
    rows = [(i, " ".join(rnd.choices(words[lang], k=rnd.randint(2, 60))).title(), lang, "s") for i, lang in enumerate(rnd.choices(sorted(words), k=300))]
    odd = [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "12 -- 7", "yy", "s"), (None, "kai kai", None, None), (1003, "sche " * 20000, None, "s"), (1003, "sche " * 20000, None, "s")]
    docs = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    got = {r.doc_id: r for r in language_id(docs).collect()}
    held = [r for r in docs.where(held_out(docs["doc_id"])).collect() if r.lang and r.doc_id < 1000]
    assert len(held) > 30 and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == [UNKNOWN, UNKNOWN, UNKNOWN, "xx", "yy"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id(docs.where("lang is null")).collect()} == {UNKNOWN}
