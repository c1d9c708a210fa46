import hashlib
import random
import re
from collections import defaultdict

from sigspark.llm.exact_dedup import exact_dedup

DOCS = "doc_id long, text string, keep_id string, n int"


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for d, t in rows:
        groups[norm(t)].append((d, t or ""))
    out = []
    for d, t in rows:
        own = groups[norm(t)]
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        kept = d == best[0] and len(t or "") == len(best[1])
        out.append((d, best[0], len(own), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(9)
    texts = ["", "ab c", "abc", "a bc", "é x", "ÉX", "long " * 5000, "z\x1cz"]
    rows = []
    for i in range(300):
        t = rnd.choice(texts)
        rows.append((i - 20, None if t == "" and i % 2 else "".join(rnd.choice(["", " ", "\n", "\t"]) + c for c in t[:50]) + t[50:]))
    rows += [(9999, "same"), (9999, "same"), (None, "same"), (None, "alone"), (2**62, "far"), (-(2**62), "far")]
    got = exact_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(7))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).collect() == []
