"""Language ID by cross-parsing: a text is cut into the longest phrases that occur in a language's labelled text.

A suffix automaton of each language's sample recognises exactly the substrings of the sample, so a greedy walk through it,
begun anew at its root whenever no transition fits, yields the longest matches. The language that needs the fewest phrases wins, after
phrases are weighed by the logarithm of the sample's length, the cost of pointing into it.

Texts are lower-cased UTF-8 in which runs of ASCII characters other than letters are one blank. They are parsed whole. So that many bytes walk
side by side through one transition table, a text is begun at every LANE bytes; each walk goes on OVER bytes into the next one's
lane, and from the first byte at which phrases of both begin, they are the same parse. The phrases before it are counted by the walk that
came from the text's beginning, so the count is that of one walk through the whole text. A text whose walks do not meet is walked once more, alone.

The samples are bounded: SAMPLE_DOCS labelled rows of each language, chosen by a hash of doc_id, and of each PIECE characters that begin where
a hash of doc_id says in the whole text, up to SAMPLE_BYTES a language (fewer where there are many languages: ALL_BYTES in all).
Defined results: `und` with score 0 for null, for texts without a letter, and if nothing was learnt (an empty table has no rows); ties go to the
first language by code point; very long texts are parsed whole; rows that repeat are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_batches

SAMPLE_DOCS, PIECE, SAMPLE_BYTES, ALL_BYTES = 100, 400, 32_000, 800_000
LANE, OVER = 512, 128
#: Bytes of text that walk at the same time.
BATCH_BYTES = 1 << 20
UNKNOWN = "und"
_BLANK = np.full(256, 32, dtype=np.uint8)
_BLANK[97:123] = np.arange(97, 123)
_BLANK[128:] = np.arange(128, 256)


def normalised(text: str) -> np.ndarray:
    raw = _BLANK[np.frombuffer(text.lower().encode(), dtype=np.uint8)]
    blank = raw == 32
    return raw[~(blank & np.append(True, blank[:-1]))]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the states of the automaton that accepts the substrings of data; 0 is the root (Blumer et al., 1985)."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in data:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class CrossParser:
    """Phrase counts of texts against each of the samples."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.names = [name for name, _ in samples]
        self.cost = np.array([math.log2(len(s) + 2) for _, s in samples])
        used = sorted({c for _, s in samples for c in s})
        self.symbol = np.full(256, len(used), dtype=np.int32)  # the last symbol has no transition
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        # one table for all samples; state 0 is dead, and the roots stand where `roots` says
        tables, self.roots, at = [np.zeros((1, self.width), dtype=np.int32)], [], 1
        for _, s in samples:
            step = suffix_automaton(s)
            own = np.zeros((len(step), self.width), dtype=np.int32)
            for i, moves in enumerate(step):
                for c, to in moves.items():
                    own[i, self.symbol[c]] = (to + at) * self.width
            tables.append(own)
            self.roots.append(at * self.width)
            at += len(step)
        self.table = np.concatenate(tables).ravel()  # states are row offsets

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows: samples; columns: texts."""
        out = np.zeros((len(self.roots), len(texts)), dtype=np.int64)
        if not sum(map(len, texts)):
            return out
        owner = np.concatenate([np.full(-(-len(t) // LANE), i) for i, t in enumerate(texts)])
        lanes = [t[i : i + LANE + OVER] for t in texts for i in range(0, len(t), LANE)]
        begins = self._begins(lanes)
        counts = begins[:LANE].sum(axis=0)
        # where a lane follows another one: phrases of the former one up to the first byte at which phrases of both begin
        first = np.flatnonzero(owner[1:] == owner[:-1])
        if len(first):
            ours, theirs = begins[LANE:, :, first], begins[:OVER, :, first + 1]
            both = ours & theirs
            until = np.arange(OVER)[:, None, None] < np.where(both.any(axis=0), both.argmax(axis=0), OVER)
            counts[:, first] += (ours & until).sum(axis=0) - (theirs & until).sum(axis=0)
            lost = ~both.any(axis=0) & (np.array([len(lanes[k]) for k in first + 1]) > OVER)
        for i in range(len(out)):
            out[i] = np.bincount(owner, counts[i], minlength=len(texts))
            if len(first):
                for k in np.unique(owner[first[lost[i]]]):
                    out[i, k] = self._walk(self.roots[i], texts[k])
        return out

    def _begins(self, lanes: list[np.ndarray]) -> np.ndarray:
        """By byte, sample and lane: whether a phrase begins there."""
        sizes = np.array([len(x) for x in lanes], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        text = np.full((LANE + OVER, len(lanes)), self.width - 1, dtype=np.int32)
        for place, k in enumerate(order):
            text[: sizes[k], place] = self.symbol[lanes[k]]
        active = np.searchsorted(-sizes[order], -np.arange(LANE + OVER), side="left")  # lanes longer than j
        roots = np.array(self.roots, dtype=np.int32)[:, None]
        state = np.broadcast_to(roots, (len(roots), len(lanes))).copy()
        begins = np.zeros((LANE + OVER, *state.shape), dtype=bool)
        for j in range(LANE + OVER):
            n = active[j]
            if not n:
                break
            c = text[j, :n]
            to = self.table[state[:, :n] + c]
            ends = to == 0
            begins[j, :, :n] = ends | (state[:, :n] == roots)
            which, lane = np.nonzero(ends)
            again = self.table[roots[which, 0] + c[lane]]  # the symbol begins the next phrase, or is one that the sample lacks
            to[which, lane] = np.where(again == 0, roots[which, 0], again)
            state[:, :n] = to
        out = np.empty_like(begins)
        out[:, :, order] = begins
        return out

    def _walk(self, root: int, text: np.ndarray) -> int:
        table, state, count = self.table, root, 0
        for c in self.symbol[text].tolist():
            to = int(table[state + c])
            if not to or state == root:
                count += 1
            state = to or int(table[root + c]) or root
        return count

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        group: list[np.ndarray | None] = []
        size = 0
        for text in texts:
            known = text is not None and any(map(str.isalpha, text))
            group.append(normalised(text) if known else None)
            size += len(group[-1]) if known else 0
            if size >= BATCH_BYTES:
                yield from self._answers(group)
                group, size = [], 0
        yield from self._answers(group)

    def _answers(self, group: list[np.ndarray | None]) -> Iterator[tuple[str, float]]:
        bits = iter((self.phrases([t for t in group if t is not None]) * self.cost[:, None]).T)
        for t in group:
            if t is None:
                yield UNKNOWN, 0.0
                continue
            b = next(bits)
            best = int(b.argmin())
            rest = np.delete(b, best)
            yield self.names[best], float(1 - b[best] / rest.min()) if len(rest) else 1.0


_parsers: dict[tuple, CrossParser] = {}


def _parser(samples: tuple[tuple[str, bytes], ...]) -> CrossParser:
    if samples not in _parsers:
        _parsers.clear()
        _parsers[samples] = CrossParser(samples)
    return _parsers[samples]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> tuple[tuple[str, bytes], ...]:
    """The sample of each language from the rows of docs (doc_id, text, lang) that are not held out; a bounded sample reaches the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.rlike("text", F.lit(r"\p{L}")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("learn"), "doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE_DOCS)
    begin = F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.greatest(F.lit(1), F.length("text") - PIECE + 1)).cast("int") + 1
    piece = F.substring(F.col("text"), begin, F.lit(PIECE)).alias("text")
    texts = rows.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "doc_id", "rank", piece).distinct().collect()  # SAMPLE_DOCS pieces a language
    by: dict[str, list] = {}
    for r in texts:
        by.setdefault(r.lang, []).append(r)
    share = min(SAMPLE_BYTES, max(500, ALL_BYTES // max(1, len(by))))
    return tuple((lang, b" ".join(normalised(r.text).tobytes() for r in sorted(by[lang], key=lambda r: (r["rank"], r.text)))[:share]) for lang in sorted(by))


def language_id(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score (1 - fewest weighed phrases / second fewest)."""
    small_batches(docs.sparkSession)
    samples = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = list(_parser(samples).predict(texts)) if samples else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
