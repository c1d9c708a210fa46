"""Line dedup by content-defined line chunks: runs of lines that repeat across documents are removed from all but one.

Lines end at a newline, after each word that ends a sentence, and, in longer ones, after the words of least hash among any SPAN that
follow each other, so no line is longer than SPAN words. A rolling hash over the hashes of a line and the one before stands at each
line's end; the ends whose rolling hash is the least in any WINDOW words that follow each other are chunk boundaries, and so are newlines, over
which no window reaches. They depend on the words around them alone, so a passage is cut in the same places wherever it stands, but for its first and last words.

From each boundary, the chunk to the first one that makes it large enough is looked up, and the chunk to each newline from the last one: large
enough are MIN_WORDS words with the ends of two natural lines or sentences, or LONG_WORDS words. A chunk that documents of different
doc_id hold stays in those of the smallest, after all its occurrences have been compared byte by byte (words joined by one blank); hashes
with different contents are left alone. Up to about WINDOW words before the first boundary and after the last one of a passage
stay where it begins or ends amid a line.

Defined results: null and empty texts stay as they are; rows without doc_id are neither compared nor changed; rows with one
doc_id count as one document; repeats inside one document are no repeats; very long texts and lines are chunked whole; an empty table
gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ._shared import discard, row_schema, small_batches, store
from .near_dedup import linked
from .words import BLOCK, WHITE, mixed, prefix_powers, shingles, text_word_hashes, word_spans

MIN_WORDS, LONG_WORDS = 10, 16
#: Of so many words that follow each other, one at least is the last of its line, or of its chunk.
SPAN, WINDOW = 8, 12
#: A document that would lose this share of its words to one other document may be a copy, if copies are to be left to document dedup: their similarity decides.
COPY_SHARE = 0.25
_U = np.uint64
_ROLL = _U(0xD6E8FEB86659FD93)
_SPACE = bytes(range(9, 14)) + b" "


class Chunks(NamedTuple):
    """Of a text: hash, first word and last word + 1 of each chunk; where the words begin and end."""

    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def chunks(texts: Sequence[bytes]) -> Iterator[Chunks]:
    """The chunks of each text; small texts are worked through together."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        if group and size + len(t) > BLOCK:
            yield from _group_chunks(group)
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield from _group_chunks(group)


def _least(values: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """The places of the least value, of equal ones the first, in each `size` places of a part that follow each other."""
    at, step = np.arange(len(values)), 1
    while step < size:
        by = min(step, size - step)
        left, right = at[:-by], at[by:]
        at = np.where(values[right] < values[left], right, left)
        step += by
    return at[part[: len(at)] == part[len(part) - len(at) :]]


def _run_hash(total: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the words a .. b, from the sums of their hashes times powers."""
    return mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def line_ends(hashes: np.ndarray, natural: np.ndarray) -> np.ndarray:
    """Which words end a line: those that end a natural one, and the least of each SPAN words within it."""
    out = natural.copy()
    out[_least(hashes, np.cumsum(natural) - natural, SPAN)] = True
    return out


def boundaries(lines: np.ndarray, last: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """Words at which chunks end, exclusive: where the rolling hash over a line's and the former line's hash is the least in WINDOW of n words.

    lines, last, part: each line's hash, its last word, and the newlines before it, over which nothing rolls.
    """
    before = np.zeros_like(lines)
    before[1:] = np.where(part[1:] == part[:-1], lines[:-1], _U(0))
    value = np.full(n, 2**64 - 1, dtype=np.uint64)
    value[last] = mixed(lines * _ROLL + before) >> _U(1)
    of_word = np.repeat(part, np.diff(last, prepend=-1))
    chosen = np.zeros(n, dtype=bool)
    chosen[_least(value, of_word, WINDOW)] = True
    is_end = np.zeros(n, dtype=bool)
    is_end[last] = True
    return np.flatnonzero(chosen & is_end) + 1


def _group_chunks(group: list[bytes]) -> Iterator[Chunks]:
    data = b"\n".join(group)
    hashes, start, stop = word_spans(data, WHITE)
    n = len(hashes)
    begins = np.cumsum([0, *(len(t) + 1 for t in group)])[:-1]
    words = np.searchsorted(start, begins)  # the first word of each text
    if n:
        raw = np.frombuffer(data, dtype=np.uint8)
        newline = np.flatnonzero(raw == 10)
        natural = np.ones(n, dtype=bool)
        natural[:-1] = np.searchsorted(newline, start[1:]) > np.searchsorted(newline, stop[:-1])
        lines_end = np.flatnonzero(natural) + 1
        mark = raw[stop - 1]
        natural |= (mark == 46) | (mark == 33) | (mark == 63)
        last = np.flatnonzero(line_ends(hashes, natural))
        first = np.concatenate([[0], last[:-1] + 1])
        part = np.searchsorted(lines_end, first, side="right")
        powers, inverse = prefix_powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * powers[:n], out=total[1:])
        rolled = boundaries(_run_hash(total, inverse, first, last + 1), last, part, n)
        cuts = np.unique(np.concatenate([[0], rolled, lines_end]))
        upto = np.concatenate([[0], np.cumsum(natural)])[cuts]  # natural ends up to each cut
        at = np.arange(len(cuts))
        to = np.maximum(np.searchsorted(cuts, cuts + MIN_WORDS), np.searchsorted(upto, upto + 2))
        to = np.minimum(to, np.searchsorted(cuts, cuts + LONG_WORDS))
        at, to = at[to < len(cuts)], to[to < len(cuts)]
        z = np.searchsorted(cuts, lines_end)
        back = np.minimum(np.searchsorted(cuts, lines_end - MIN_WORDS, side="right"), np.searchsorted(upto, upto[z] - 2, side="right"))
        back = np.maximum(back, np.searchsorted(cuts, lines_end - LONG_WORDS, side="right")) - 1
        z, back = z[back >= 0], back[back >= 0]
        pairs = np.unique(np.concatenate([at * len(cuts) + to, back * len(cuts) + z]))
        a, z = cuts[pairs // len(cuts)], cuts[pairs % len(cuts)]
        of = np.searchsorted(words, a, side="right") - 1
        inside = z <= np.append(words[1:], n)[of]  # in one text
        a, z, of = a[inside], z[inside], of[inside]
        found = _run_hash(total, inverse, a, z)
    else:
        found, a, z, of = hashes, start, start, start
    bounds, ends_of = np.searchsorted(of, np.arange(1, len(group))), words[1:]
    parts = zip(np.split(found, bounds), np.split(a, bounds), np.split(z, bounds), np.split(start, ends_of), np.split(stop, ends_of), words, begins, strict=True)
    for h, x, y, s, e, w, b in parts:
        yield Chunks(h, x - w, y - w, s - b, e - b)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique(c.hash).view(np.int64) for c in chunks([(t or "").encode() for t in b.column("text").to_pylist()])]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found])))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), hashes], names=["doc_id", "hashes"])


def _among(found: np.ndarray, wanted: Collection[int]) -> np.ndarray:
    """Which of the hashes are wanted."""
    known = set(wanted)
    return np.fromiter((h in known for h in found.view(np.int64).tolist()), dtype=bool, count=len(found))


def _contents(data: bytes, c: Chunks, wanted: Collection[int]) -> dict[int, bytes]:
    """The bytes of the chunks that a document was found to share."""
    shared = _among(c.hash, wanted)
    return {h: b" ".join(data[c.start[i] : c.stop[j - 1]].split()) for h, i, j in zip(c.hash[shared].view(np.int64).tolist(), c.first[shared].tolist(), c.last[shared].tolist(), strict=True)}


def _covered(n: int, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, z, -1)
    return np.cumsum(edge[:-1]) > 0


def copied(c: Chunks, removed: dict[int, int]) -> int | None:
    """The document to which this one would lose COPY_SHARE of its words, if there is one."""
    gone, n = _among(c.hash, removed), len(c.start)
    if not gone.any():
        return None
    keeper = np.array([removed[h] for h in c.hash[gone].view(np.int64).tolist()])
    names, counts = np.unique(keeper, return_counts=True)
    most = names[counts.argmax()]
    one = keeper == most
    return int(most) if _covered(n, c.first[gone][one], c.last[gone][one]).sum() >= COPY_SHARE * n else None


def cut(data: bytes, c: Chunks, removed: dict[int, int], leave_copies: bool) -> tuple[bytes, int, int, int]:
    """The text without the chunks of these hashes (with the documents that keep them), its words before, the words removed, and the chunks.

    leave_copies: the chunks stay that the document named by `copied` keeps.
    """
    if leave_copies:
        most = copied(c, removed)
        removed = {h: k for h, k in removed.items() if k != most}
    gone = _among(c.hash, removed)
    start, n = c.start, len(c.start)
    if not gone.any():
        return data, n, 0, 0
    a, z = c.first[gone], c.last[gone]
    out = _covered(n, a, z)
    lost = int(out.sum())
    change = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))  # kept runs of words
    parts = []
    for i, j in zip(change[::2], change[1::2], strict=True):
        # a kept run takes the white space that follows it, up to the first word that is removed
        parts.append(data[start[i] if i else 0 : start[j] if j < n else len(data)])
    return b"".join(parts).rstrip(_SPACE), n, lost, int(gone.sum())


def _applied(leave_copies: bool):
    """Cuts the texts, and lists the contents of the chunks they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: list[tuple] = []
            texts = [None if p is None else unpack(p) for p in b.column("packed").to_pylist()]
            shared = [{h: s["keeper"] for s in lists or () for h in s["hashes"]} for lists in b.column("shared").to_pylist()]
            found = chunks([t for t, s in zip(texts, shared, strict=True) if s and t is not None])
            for data, keepers, doc_id in zip(texts, shared, b.column("id").to_pylist(), strict=True):
                if data is None:
                    out.append((None, 0, 0, 0, None, None, []))
                    continue
                c = next(found) if keepers else None
                contents = list(_contents(data, c, keepers).items()) if keepers else []
                gone = {h: k for h, k in keepers.items() if k != doc_id}
                text, *counts = cut(data, c, gone, False) if gone else (data, len(data.split()), 0, 0)
                most = copied(c, gone) if leave_copies and gone else None
                out.append((text.decode(), *counts, most, None if most is None else cut(data, c, gone, True)[0].decode(), [{"hash": h, "content": x} for h, x in contents]))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("hash", pa.int64()), ("content", pa.binary())])))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["row", "id", "text", "n_words", "removed_words", "removed_chunks", "keeper", "whole", "contents"])

    return run


def _compared(percent: int):
    """Adds whether a copy is as similar to what is left of its keeper as document dedup asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            near = []
            for whole, kept in zip(b.column("whole").to_pylist(), b.column("kept").to_pylist(), strict=True):
                if kept != last[0]:
                    last = kept, shingles(next(text_word_hashes([kept])))
                near.append(kept is not None and linked(shingles(next(text_word_hashes([whole]))), last[1], percent))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("row", "text", "whole")), pa.array(near, pa.bool_())], names=["row", "text", "whole", "near"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=5).compress
    for b in batches:
        packed = pa.array([None if t is None else pack(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), packed], names=["row", "id", "packed"])


def _cut_rows(docs: DataFrame, leave_copies: bool) -> tuple[DataFrame, DataType]:
    """The rows of `line_dedup` with id, keeper and whole (of copies: `copied` and the text that `cut` leaves them), stored, and the type of row.

    Hashes are grouped with map-side minima, so a chunk of a third of all documents is a row per task; texts are chunked once to find
    what they share, and shuffled once, packed, beside the chunks of their document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    row_type = rows.schema["row"].dataType
    packed = rows.mapInArrow(_packed, row_schema(row_type, "id long, packed binary"))

    def done(but: DataFrame | None) -> DataFrame:
        found = store(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_hashed, "doc_id long, hashes array<long>"), "line-chunks")
        pairs = found.select("doc_id", F.explode("hashes").alias("hash"))
        groups = pairs.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").drop("last")
        groups = groups if but is None else groups.join(but, "hash", "left_anti")
        # dealt by doc_id once for both groupings; a document's chunks are listed by the document that keeps them
        by_keeper = pairs.join(groups, "hash").repartition("doc_id").groupBy("doc_id", "keeper").agg(F.collect_list("hash").alias("hashes"))
        shared = store(by_keeper.groupBy("doc_id").agg(F.collect_list(F.struct("keeper", "hashes")).alias("shared")), "line-shared")
        discard(found)
        marked = packed.join(shared, packed["id"] == shared["doc_id"], "left").drop("doc_id")
        cut_rows = store(marked.mapInArrow(_applied(leave_copies), row_schema(row_type, "id long, text string, n_words long, removed_words long, removed_chunks long, keeper long, whole string, contents array<struct<hash:long,content:binary>>")), "line-cut")
        discard(shared)
        return cut_rows

    out = done(None)
    contents = out.select(F.explode("contents").alias("x")).select("x.*")
    differ = contents.groupBy("hash").agg(F.min("content").alias("least"), F.max("content").alias("most")).where("least <> most").select("hash")
    bad = store(differ, "line-collisions")
    if not bad.isEmpty():  # contents of equal 64-bit hashes: cut anew without these chunks
        discard(out)
        out = done(bad)
    discard(bad)
    return out.drop("contents"), row_type


def line_dedup(docs: DataFrame) -> DataFrame:
    """row (the columns of docs but text), the remaining text, n_words before, removed_words and removed_chunks."""
    return _cut_rows(docs, False)[0].drop("id", "keeper", "whole")


def line_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, removed_words, removed_chunks and the remaining text."""
    return line_dedup(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "removed_words", "removed_chunks", "text")


def without_repeated_lines(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs, its columns, with the remaining texts; near-duplicates of what is left of the document that keeps their text are left to document dedup.

    A document of any length that would lose COPY_SHARE of its words to one other document keeps these words only if both remaining
    texts reach percent by the measure of `near_dedup`, so that the next stage links them. All others lose their repeated chunks, and
    so do documents whose keeper would itself lose that share. Of a keeper of several rows, one is compared.
    """
    done, row_type = _cut_rows(docs, True)
    copies, others = done.where("keeper is not null"), done.where("keeper is null")
    kept = others.select(F.col("id").alias("keeper"), F.col("text").alias("kept")).join(copies.select("keeper").distinct(), "keeper", "left_semi").groupBy("keeper").agg(F.min("kept").alias("kept"))
    told = copies.join(kept, "keeper", "left").select("row", "text", "whole", "kept").mapInArrow(_compared(percent), row_schema(row_type, "text string, whole string, near boolean"))
    out = others.select("row", "text").unionByName(told.select("row", F.when(F.col("near"), F.col("whole")).otherwise(F.col("text")).alias("text")))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
