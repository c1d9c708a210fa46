import random

import numpy as np

from sigspark.llm.line_dedup import chunks, cut, line_dedup, line_report, without_repeated_lines

DOCS = "doc_id long, text string, shared string, removed_words int"


def sentences(rnd, n):
    return [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(6, 14))) + rnd.choice([".", "!", "."]) for _ in range(n)]


def test_passages_are_found_wherever_they_stand():
    rnd, whole = random.Random(7), 0
    for _ in range(200):
        passage = []
        while sum(len(x.split()) for x in passage) <= 50:
            passage += sentences(rnd, 1)
        p = " ".join(passage)
        a, b = ("\n".join([" ".join(sentences(rnd, 9)), p, " ".join(sentences(rnd, 9))]).encode() for _ in range(2))
        of_a, of_b = chunks([a, b])
        shared = np.intersect1d(of_a.hash, of_b.hash).view(np.int64).tolist()
        text, _, lost, _ = cut(b, of_b, dict.fromkeys(shared, 0), False)
        around = (b[: b.find(p.encode())] + b[b.find(p.encode()) + len(p) :]).split()
        assert 0.7 * len(p.split()) <= lost <= len(p.split()) and len(text.split()) == len(b.split()) - lost
        whole += text.split() == around
    assert whole >= 180


def test_chunks_do_not_depend_on_the_batch():
    texts = [t.encode() for t in ("a. " * 5000, "x " * 5000, "a b c d e f g h.\n" * 900, "", " \n", "one", "long words here. " * 90_000, "b c. " * 60)]
    for t, c in zip(texts, chunks(texts), strict=True):
        alone = next(chunks([t]))
        assert all((x == y).all() for x, y in zip(c, alone, strict=True))
        assert len(c.start) == len(t.split()) >= len(c.hash) and ((c.last - c.first) >= 10).all()
        assert [t[i:j] for i, j in zip(c.start, c.stop, strict=True)][:50] == t.split()[:50]


def brute(rows):
    """The same decisions on whole texts, with chunks compared as bytes."""
    held = {}
    for d, t in rows:
        if d is None or t is None:
            continue
        data = t.encode()
        c = next(chunks([data]))
        for x, i, j in zip(c.hash.view(np.int64).tolist(), c.first, c.last, strict=True):
            held.setdefault((x, b" ".join(data[c.start[i] : c.stop[j - 1]].split())), set()).add(d)
    out = []
    for d, t in rows:
        gone = {x: min(docs) for (x, _), docs in held.items() if len(docs) > 1 and d in docs and d != min(docs)}
        out.append((d, t if t is None or d is None else cut(t.encode(), next(chunks([t.encode()])), gone, False)[0].decode()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    common = [" ".join(sentences(rnd, 6)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [" ".join(sentences(rnd, rnd.randint(1, 6))) for _ in range(rnd.randint(1, 4))] + rnd.choices(common, k=rnd.randint(0, 2))
        rnd.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows[3] = (3, " ".join(sentences(rnd, 15)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (200, None), (201, ""), (None, rows[5][1]), (202, common[0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(4)
    got = sorted(((r.doc_id, r.text) for r in line_report(docs).collect()), key=str)
    assert got == brute(rows)
    texts = dict(got)
    assert texts[3] == rows[3][1] or texts[3] in rows[3][1]
    assert texts[100] == texts[101] == ""
    kept = without_repeated_lines(docs)
    left = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == ["doc_id", "text", "shared", "removed_words"] and left[100].text == rows[3][1] and left[100].shared == "x"
    for p in common:  # a passage stays once
        assert sum(p in (r.text or "") for r in left.values() if r.doc_id not in (None, 100, 101, 202)) <= 1


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_only_confirmed_copies_are_left_to_document_dedup(spark):
    rnd = random.Random(9)
    passage, own = " ".join(sentences(rnd, 9)), [" ".join(sentences(rnd, n)) for n in (100, 1, 1)]
    whole = " ".join(sentences(rnd, 30))
    rows = [(1, f"{own[0]}\n{passage}"), (2, f"{passage}\n{own[1]}"), (3, f"{own[2]}\n{passage}"), (4, whole), (5, whole + " end")]
    rows = [(d, t + "\n" + " ".join(sentences(rnd, 1)) if d < 4 else t) for d, t in rows]
    assert all(len(t.split()) >= 100 for _, t in rows[:2])
    left = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)).collect()}
    assert left[1] == rows[0][1] and left[4] == left[5][: len(whole)] == whole and left[5] == rows[4][1]
    assert passage not in left[2] and passage not in left[3]  # mostly a passage of document 1, but nothing like it


def found_between(rnd, words, sentence, n=200):
    """In how many of n pairs of texts of such sentences (0: no marks) a passage of so many words amid lines is found, and the share of its words."""
    found, lost = 0, 0

    def prose(k):
        return [f"w{rnd.randrange(5000)}" + ("." if sentence and rnd.random() < 1 / sentence else "") for _ in range(k)]

    for _ in range(n):
        p = prose(words)
        a, b = (" ".join([*prose(80), *p, *prose(80)]).encode() for _ in range(2))
        of_a, of_b = chunks([a, b])
        gone = cut(b, of_b, dict.fromkeys(np.intersect1d(of_a.hash, of_b.hash).view(np.int64).tolist(), 0), False)[2]
        found += gone > 0
        lost += gone
    return found, lost / (n * words)


def test_passages_amid_lines_are_never_missed():
    rnd = random.Random(10)
    for words in (51, 60, 100, 150):
        for sentence in (10, 20, 30, 0):
            assert found_between(rnd, words, sentence)[0] == 200


def test_the_short_last_lines_of_a_passage_are_found():
    rnd = random.Random(11)
    for _ in range(100):
        words = [f"w{rnd.randrange(5000)}" for _ in range(60)]
        ends = np.cumsum([20, 15, 8, 12, 3, 2])
        p = "\n".join(" ".join(words[j - n : j]) for j, n in zip(ends, [20, 15, 8, 12, 3, 2], strict=True))
        alone = [" ".join(sentences(rnd, 9)) for _ in range(3)]
        a, b, last = f"{alone[0]}\n{p}\n{alone[1]}".encode(), f"{alone[2]}\n{p}\n{alone[0][::-1]}".encode(), f"{alone[2]}\n{p}".encode()
        of_a, *others = chunks([a, b, last])
        for t, c in zip((b, last), others, strict=True):
            shared = np.intersect1d(of_a.hash, c.hash).view(np.int64).tolist()
            text, _, lost, _ = cut(t, c, dict.fromkeys(shared, 0), False)
            assert lost == 60 and text.split() == t.replace(p.encode(), b"").split()


def test_near_duplicates_of_any_length_stay_whole(spark):
    rnd = random.Random(12)
    rows = []
    for n in (24, 30, 45, 60, 61, 80, 99, 100, 101, 150, 300):
        for marks in (6, 15, 0):
            words = [f"w{rnd.randrange(5000)}" + ("." if marks and rnd.random() < 1 / marks else "") for _ in range(n)]
            other = [*words[:-1], "end"]
            if n >= 60:
                other[n // 2] = "changed"
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    left = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), 80).collect()}
    assert [d for d, t in rows if left[d] != t] == []
