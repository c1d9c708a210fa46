import heapq
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sigspark.llm.mixing import BLOCK_WORDS, mix, mixed_documents, mixture_report, sainte_lague, targets

DOCS = "doc_id long, text string, source string, target string"


def seats_one_by_one(w, seats):
    """Seats by highest quotients, one at a time."""
    k = [0] * len(w)
    heap = [(-x, i) for i, x in enumerate(w) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        k[i] += 1
        heapq.heappush(heap, (-w[i] / (2 * k[i] + 1), i))
    return k


@given(st.lists(st.integers(0, 1000), max_size=8), st.integers(0, 60))
def test_seats_go_to_the_highest_quotients(w, seats):
    got, want = sainte_lague(w, seats).tolist(), seats_one_by_one(w, seats)
    quotient = lambda k: sorted((x / (2 * j + 1) for x, n in zip(w, k, strict=True) for j in range(n)), reverse=True)
    assert sum(got) == sum(want) and quotient(got) == pytest.approx(quotient(want))


@given(st.lists(st.integers(0, 500), min_size=1, max_size=7))
def test_targets_stop_at_three_times_the_size(sizes):
    weights = [1.0 + i % 3 for i in range(len(sizes))]
    got = targets(sizes, weights, sum(sizes))
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, w, s in zip(got, weights, sizes, strict=True) if t < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def corpus():
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.choice([0, 3, 40, 200]))), rnd.choice(["a", "a", "a", "B", "é", "big", "big", None]), "x") for i in range(400)]
    return rows + [(1000, None, "empty", "x"), (1001, "one", "tiny", "x"), (1001, "one", "tiny", "x"), (None, "two words", "tiny", "x")]


def test_sources_come_near_their_targets(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = mixture_report(docs.repartition(5)).collect()
    assert sorted(map(tuple, mixture_report(docs.repartition(2)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    size, taken = Counter(), Counter()
    for r in got:
        name = source[r.doc_id]
        size[name] += r.size
        taken[name] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(size.values())), strict=True))
    for r in got:
        assert r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= BLOCK_WORDS for s in names)
    # whole passes of a source, then its first blocks: all of a document, nothing, or, of one, its first words
    seats = dict(zip(names, seats_one_by_one([want[s] for s in names], round(sum(want.values()) / BLOCK_WORDS)), strict=True))
    for name in names:
        take = min(seats[name] * BLOCK_WORDS, 3 * size[name])
        passes, rest = divmod(take, size[name]) if size[name] else (0, 0)
        more = [(r.taken - passes * r.size, r.size) for r in got if source[r.doc_id] == name]
        assert sum(m for m, _ in more) == rest and all(0 <= m <= n for m, n in more) and sum(0 < m < n for m, n in more) <= 1


def test_rows_of_one_doc_id_stand_in_one_order(spark):
    rows = [(7, f"{w} one two three four", "a", "x") for w in "abcdefghij"] + [(8, "word " * 400, "b", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    taken = [sorted(r.text for r in mixed_documents(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert taken[0] == taken[1] == taken[2]


def test_small_shards_keep_the_totals(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    rows = mix(docs, shard_words=500).collect()
    by = defaultdict(float)
    for r in rows:
        by[r.source] += r["_taken"]
    goal = {r.source: r["_target"] for r in rows}
    assert all(abs(by[s] - goal[s]) <= 0.05 * goal[s] + BLOCK_WORDS for s in goal)


def test_mixed_documents_hold_the_words_taken(spark):
    docs = spark.createDataFrame([(*r, 5, "row", 7.0) for r in corpus()], DOCS + ", _size int, _row string, _last double")
    said = defaultdict(int)
    for r in mixture_report(docs).collect():
        said[r.doc_id] += r.taken
    out = mixed_documents(docs)
    assert out.schema == docs.schema
    words, text = Counter(), {r[0]: r[1] or "" for r in corpus()}
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert text[r.doc_id].startswith(r.text) and r.text
    assert dict(words) == {d: n for d, n in said.items() if n}
    assert mixed_documents(docs.limit(0)).collect() == [] and mixture_report(docs.limit(0)).collect() == []
