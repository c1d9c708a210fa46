import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.llm.packing import WINDOW, nnls, pack, plan_windows

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, sequence_id long, length int"


def brute(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, most_padding):
    """texts: of each row of the table; rows that repeat make as many pieces."""
    ids = {i: brute(t) for i, t in texts}
    copies = Counter(i for i, _ in texts)
    covered, windows = defaultdict(Counter), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(part, dtype="<u4").tobytes())
        covered[r.doc_id].update(range(r.start, r.start + r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert {i: dict(c) for i, c in covered.items()} == {i: dict.fromkeys(range(len(ids[i])), copies[i]) for i in ids}
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= WINDOW
    assert len(windows) * WINDOW - sum(r.length for r in rows) <= most_padding


def test_pieces_are_the_documents_ids(spark):
    texts = [(1, "The quick, brown. fox's ÉTÉ! don't"), (2, None), (3, ""), (4, "word. " * 6000), (4, "word. " * 6000), (5, "x" * 9000), (6, "a b c <|endoftext|> ́e ,. .,"), (7, "été. " * 3000)]
    texts += [(i, "some words, here " * (i % 977)) for i in range(10, 200)]
    got = pack(spark.createDataFrame([(i, t, 9, 9) for i, t in texts], DOCS).repartition(5), P.path("word_bpe_49k.json")).collect()
    check(got, texts, WINDOW)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS), P.path("word_bpe_49k.json")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 255), st.integers(1, 40), max_size=30))
def test_plan_covers_every_item_once(counts):
    rows, n = plan_windows(counts, 256, 16)
    covered, used = defaultdict(Counter), Counter()
    for r, a, b, start, length, seq, mult, idx, at in rows:
        assert start % 16 == 0
        for i in range(a, b):
            covered[r].update((i, x) for x in range(start, start + length))
            place = seq + (idx + i - a) // mult, at + (idx + i - a) % mult * length
            assert place[0] < n and place[1] + length <= 256
            used.update((place[0], x) for x in range(place[1], place[1] + length))
    assert all(covered[r] == Counter((i, x) for i in range(c) for x in range(r)) for r, c in counts.items())
    assert set(used.values()) <= {1}
    assert n * 256 - sum(r * c for r, c in counts.items()) <= 16 * n + 256


def test_nnls_matches_the_conditions_of_optimality():
    rng = np.random.default_rng(3)
    a = (rng.random((12, 30)) < 0.2) * rng.integers(1, 3, (12, 30))
    a = a[:, a.any(axis=0)]
    goal = rng.integers(0, 50, 12).astype(float)
    x = nnls([tuple((i, int(v)) for i, v in enumerate(c) if v) for c in a.T], goal, sweeps=4000)
    grad = a.T @ (a @ x - goal)
    assert (grad > -1.5).all() and (np.abs(grad[x > 0.5]) < 2).all()
