"""Packing documents into token windows by non-negative least squares over a length histogram.

A document's tokens are cut into whole windows and a remainder. The remainders' histogram (at most WINDOW
counts) is all that reaches the driver, where combinations of two or three lengths that fill a window exactly
are enumerated, their repeat counts are solved against the histogram by non-negative least squares and rounded down,
and what is left is packed greedily, longest first; only where nothing left fits a gap is a remainder cut.
The plan is a table of rank ranges per length, so its size depends on WINDOW and not on the number of documents.

Cuts fall on multiples of CUT tokens, for which checksums are kept, so no text is tokenised twice.
Defined results: null or empty text is the end-of-document id alone; rows that repeat are packed separately;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_batches, store

WINDOW = 4096
CUT = 64
END_ID = 2
#: Lengths of which all pairs are tried as parts of three-part combinations.
FREQUENT = 96
#: Distinct words whose ids a worker remembers; then it starts anew.
MEMO_WORDS = 500_000
#: Documents of one length that one task ranks.
RANK_ROWS = 100_000
#: The parts of a tokenizer file, other than its vocabulary, whose texts are encoded word by word.
_WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
    {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
)
#: UTF-8 of letters a-z, and of the lower-case ones up to U+00FF, with ASCII marks after them: two pieces to the tokenizer. NFC leaves them as they are.
_SIMPLE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){1,40})([!-/:-@\[-`{-~]{0,20})")
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordMerges:
    """Byte-pair merges of many words at once: in each, the pair of least rank is merged, of equal ones the first, until no pair has a rank."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        char = {int(b): c for b, c in enumerate(_byte_chars())}
        self.first = np.array([vocab[char[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[char[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)  # the rank of pairs that are never merged
        self.keys, self.rank, self.made = np.append(keys[order], self.base**2), np.append(order, self.none), np.append(made[order], 0)

    def _place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, self.none)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out: list[bytes] = [b""] * len(words)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            ids, left = self._merged(np.frombuffer(b"".join([words[i] for i in which]), dtype=np.uint8).reshape(-1, size))
            flat = ids[np.arange(size) < left[:, None]].astype("<u4").tobytes()
            ends = np.cumsum(left) * 4
            for i, x, y in zip(which.tolist(), (ends - left * 4).tolist(), ends.tolist(), strict=True):
                out[i] = flat[x:y]
        return out

    def _merged(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, and how many are left of each."""
        n, size = raw.shape
        ids = self.first[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        left = np.full(n, size)
        rows, own = np.arange(n), ids
        place = self._place(ids[:, :-1], ids[:, 1:])
        while len(rows) and place.shape[1]:
            rank = self.rank[place]
            at = rank.argmin(axis=1)
            open_ = rank[np.arange(len(rows)), at] < self.none
            ids[rows[~open_], : own.shape[1]] = own[~open_]
            rows, own, place, at = rows[open_], own[open_], place[open_], at[open_]
            if not len(rows):
                return ids, left
            every = np.arange(len(rows))
            left[rows] -= 1
            made = self.made[place[every, at]]
            kept = np.arange(own.shape[1] - 1)
            own = np.take_along_axis(own, kept + (kept > at[:, None]), axis=1)
            own[every, at] = made
            kept = kept[:-1]
            place = np.take_along_axis(place, kept + (kept >= at[:, None]), axis=1)
            if place.shape[1]:
                for shift in (-1, 0):  # the pairs on both sides of the new token
                    j = at + shift
                    there = np.flatnonzero((j >= 0) & (j + 1 < own.shape[1]))
                    place[there, j[there]] = self._place(own[there, j[there]], own[there, j[there] + 1])
        ids[rows, : own.shape[1]] = own
        return ids, left


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in set(seen) else next(other)) for b in range(256)]


class WordIds:
    """Token ids of texts as little-endian uint32 bytes, the same as the tokenizer gives for whole texts without special tokens added.

    A tokenizer of `_WORDWISE`'s kind never joins tokens across ASCII white space and lower-cases: its texts are encoded word by word, with a
    bounded memory, and words of lower-case Latin letters, with or without ASCII marks after them, by `WordMerges`. Texts that
    may hold special tokens, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        model = spec["model"]
        kind = (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"], {k: v for k, v in model.items() if k not in ("vocab", "merges")})
        self.merges = WordMerges(model) if kind == _WORDWISE and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"]) else None
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)", re.IGNORECASE)
        self.memo: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        memo, split, other = self.memo, [], []
        for w in new:
            m = _SIMPLE.fullmatch(w)
            if m:
                split.append((w, *m.groups()))
            else:
                other.append(w)
        memo.update(zip(other, self._ids([w.decode() for w in other]), strict=True))
        marks = sorted({m for _, _, m in split if m and m not in memo})
        memo.update(zip(marks, self._ids([m.decode() for m in marks]), strict=True))
        stems = list({s for _, s, _ in split if s not in memo})
        memo.update(zip(stems, self.merges(stems), strict=True))
        memo.update((w, memo[s] + memo[m]) for w, s, m in split if m)

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        whole = [t or "" for t in texts]
        apart = [self.merges is None or ("<" in t and self.special.search(t) is not None) for t in whole]
        split = [[] if a else t.encode().lower().split() for t, a in zip(whole, apart, strict=True)]
        used = set().union(*split)
        if len(self.memo) > MEMO_WORDS:  # starts anew with the words of this batch
            self.memo = {w: x for w in used if (x := self.memo.get(w)) is not None}
        self._learn([w for w in used if w not in self.memo])
        known = iter(self._ids([t for t, a in zip(whole, apart, strict=True) if a]))
        get = self.memo.__getitem__
        for words, a in zip(split, apart, strict=True):
            yield next(known) if a else b"".join(map(get, words))


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def _checksums(ids: bytes, n: int) -> bytes:
    """Of each whole window, of the remainder, and of each CUT tokens of the remainder."""
    whole, rest = n // WINDOW, n % WINDOW
    at = whole * WINDOW * 4
    out = [zlib.crc32(ids[i * WINDOW * 4 : (i + 1) * WINDOW * 4]) for i in range(whole)]
    if rest:
        out.append(zlib.crc32(ids[at:]))
        out += [zlib.crc32(ids[i : i + CUT * 4]) for i in range(at, n * 4, CUT * 4)]
    return np.asarray(out, dtype="<u4").tobytes()


def _piece_checksum(blocks: np.ndarray, start: int, length: int) -> int:
    """Of tokens start .. start + length of a remainder, from its blocks; start is a multiple of CUT, and so is the end unless it is the remainder's."""
    crc, done = 0, 0
    for b in blocks[start // CUT : -(-(start + length) // CUT)]:
        zeros = bytes(4 * min(CUT, length - done))
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ int(b)  # a checksum is affine in the one before it
        done += CUT
    return crc


def _encoded(path: str):
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sums = [], []
            for ids in word_ids(path).texts(b.column("text").to_pylist()):
                n.append(len(ids) // 4 + 1)
                sums.append(_checksums(ids + end, n[-1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.binary())], names=["doc_id", "n", "sums"])

    return run


def nnls(columns: list[tuple[tuple[int, int], ...]], goal: np.ndarray, sweeps: int = 5000, tol: float = 0.05) -> np.ndarray:
    """Non-negative x with the least squares of A x - goal, by cyclic coordinate descent until nothing moves by tol, or by 2e-7 of the goal's sum; a column is ((row, entry), ...)."""
    x, left = np.zeros(len(columns)), goal.astype(float)
    tol = max(tol, 2e-7 * float(left.sum()))
    norms = [sum(v * v for _, v in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(-x[j], sum(v * left[i] for i, v in c) / norms[j])
            if step:
                x[j] += step
                for i, v in c:
                    left[i] -= v * step
                moved = max(moved, abs(step))
        if moved < tol:
            break
    return x


def exact_fills(counts: dict[int, int], window: int, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Pairs of lengths that fill a window, and triples of which two lengths are among the most frequent."""
    out = [(a, window - a) for a in counts if a >= window - a and window - a in counts]
    top = sorted(sorted(counts, key=lambda a: (-counts[a], a))[:frequent], reverse=True)
    out += sorted({tuple(sorted((a, b, window - a - b), reverse=True)) for i, a in enumerate(top) for b in top[i:] if window - a - b in counts})
    return out


def plan_windows(counts: dict[int, int], window: int = WINDOW, cut: int = CUT) -> tuple[list[tuple[int, ...]], int]:
    """Rows (length class, first rank, last rank + 1, start, length, sequence of the first, items per sequence, index of the first, offset), and the number of sequences."""
    rows: list[tuple[int, ...]] = []
    # an item class is (class, start, length); its items are rank ranges, in order
    left = {(r, 0, r): deque([[0, n]]) for r, n in counts.items() if n}
    have = {k: n for k, n in ((k, sum(b - a for a, b in q)) for k, q in left.items())}
    n_seq = 0

    def take(item, n):
        got, q = [], left[item]
        have[item] -= n
        while n:
            a, b = q[0]
            m = min(n, b - a)
            got.append((a, a + m))
            n -= m
            if a + m == b:
                q.popleft()
            else:
                q[0][0] += m
        if not have[item]:
            del have[item], left[item]
        return got

    def use(parts, times):
        nonlocal n_seq
        at = 0
        for item, length, mult in parts:
            idx = 0
            for a, b in take(item, times * mult):
                rows.append((item[0], a, b, item[1], length, n_seq, mult, idx, at))
                idx += b - a
                if length < item[2]:  # cut: the rest is an item of its own
                    rest = (item[0], item[1] + length, item[2] - length)
                    left.setdefault(rest, deque()).append([a, b])
                    have[rest] = have.get(rest, 0) + b - a
            at += length * mult
        n_seq += times

    lengths = sorted(counts)
    at = {r: i for i, r in enumerate(lengths)}
    fills = exact_fills(counts, window)
    if fills:
        columns = [tuple((at[r], f.count(r)) for r in sorted(set(f))) for f in fills]
        x = nnls(columns, np.array([counts[r] for r in lengths]))
        for j in np.argsort(-x, kind="stable"):
            parts = [((r, 0, r), r, fills[j].count(r)) for r in sorted(set(fills[j]), reverse=True)]
            times = min([int(x[j] + 1e-9), *(have.get(p[0], 0) // p[2] for p in parts)])
            if times:
                use(parts, times)
    while have:
        order = sorted(have, key=lambda k: (-k[2], k))
        space, parts = window, []
        for item in order:
            mult = min(space // item[2], have[item])
            if mult:
                parts.append((item, item[2], mult))
                space -= mult * item[2]
            if not space:
                break
        used = {p[0]: p[2] for p in parts}
        longer = [k for k in order if k[2] > space and have[k] > used.get(k, 0)] if space >= cut else []
        if longer:  # one item more is cut, of an unused class if there is one
            item = next((k for k in longer if k not in used), longer[0])
            parts.append((item, space // cut * cut, 1))
            used[item] = used.get(item, 0) + 1
        use(parts, min(have[k] // m for k, m in used.items()))
    return rows, n_seq


def _pieces(plan, whole_from: dict[int, int], n_seq: int):
    by_class: dict[int, list[np.ndarray]] = {}
    for r in sorted({p[0] for p in plan}):
        mine = np.array(sorted((p[1:] for p in plan if p[0] == r), key=lambda p: (p[2], p[0])), dtype=np.int64)
        starts = np.unique(mine[:, 2])
        by_class[r] = [mine[mine[:, 2] == s] for s in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n, sums, r, rank, before in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "sums", "r", "rank", "before")), strict=True):
                crc = np.frombuffer(sums, dtype="<u4")
                whole = n // WINDOW
                first = n_seq + whole_from[r] + before
                out += [(doc_id, j * WINDOW, WINDOW, int(crc[j]), n, first + j, 0) for j in range(whole)]
                for rows in by_class.get(r, ()) if r else ():
                    k = int(np.searchsorted(rows[:, 0], rank, side="right")) - 1
                    if k < 0 or rank >= rows[k, 1]:
                        continue
                    lo, _, start, length, seq, mult, idx, at = map(int, rows[k])
                    i = idx + rank - lo
                    sum_ = int(crc[whole]) if length == r else _piece_checksum(crc[whole + 1 :], start, length)
                    out.append((doc_id, whole * WINDOW + start, length, sum_, n, seq + i // mult, at + i % mult * length))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizer file that every executor can read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lengths = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(tokenizer), "doc_id long, n long, sums binary"), "packing-lengths")
    lengths = lengths.withColumn("r", (F.col("n") % WINDOW).cast("int")).withColumn("key", F.xxhash64("doc_id", "n", "sums"))
    seen = {x["r"]: x for x in lengths.groupBy("r").agg(F.count("*").alias("docs"), F.sum(F.expr(f"n div {WINDOW}")).alias("whole")).collect()}  # at most WINDOW rows
    plan, n_seq = plan_windows({r: x["docs"] for r, x in seen.items() if r})
    whole_from, total = {}, 0
    for r in sorted(seen):
        whole_from[r], total = total, total + seen[r]["whole"]
    # ranks within a length: a length of many documents is dealt over several tasks, and their counts are added up
    tasks = spark.createDataFrame([(r, max(1, -(-x["docs"] // RANK_ROWS))) for r, x in sorted(seen.items())], "r int, tasks long")
    dealt = lengths.join(F.broadcast(tasks), "r").withColumn("task", F.pmod("key", "tasks")).drop("tasks")  # at most WINDOW rows
    along = Window.partitionBy("r").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("r", "task").agg(F.count("*").alias("docs"), F.sum(F.expr(f"n div {WINDOW}")).alias("whole"))
    sums = sums.select("r", "task", F.coalesce(F.sum("docs").over(along), F.lit(0)).alias("rank_from"), F.coalesce(F.sum("whole").over(along), F.lit(0)).alias("whole_from"))
    inside = Window.partitionBy("r", "task").orderBy("key", "doc_id")
    upto = F.sum(F.expr(f"n div {WINDOW}")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.expr(f"n div {WINDOW}")
    ranked = dealt.join(sums, ["r", "task"]).select("doc_id", "n", "sums", "r", (F.row_number().over(inside) - 1 + F.col("rank_from")).alias("rank"), (upto + F.col("whole_from")).alias("before"))
    return ranked.mapInArrow(_pieces(plan, whole_from, n_seq), _PIECES)
