"""Alignment of two tokenizers: where their tokens end together, which ids overlap, and how often over the whole corpus.

Texts are cut into chunks at single spaces between two characters that aren't white space: neither tokenizer has a token across such
a place, so a chunk's tokens are the same wherever it stands, and each distinct chunk of a batch is encoded once. A chunk whose decoded bytes differ
from its own sends the text whole through both tokenizers. A link is one stretch between two neighbouring token ends, of either side:
exactly one token of A and one of B cover it.

Counts: pairs of ids are added up per task, dealt by stripes of B ids (B id modulo STRIPES) and added by np.add.at into a stripe's dense
matrix of B ids x A ids; row maxima give each B id's best. Scores: each batch of documents sends its distinct pairs, once each however
often it holds them, to the stripes' counts, by which they are co-partitioned, and adds up what comes back by document. So a frequent id is
one row per batch and pair, a task holds one stripe's matrix, and nothing but numbers of batches reaches the driver.

Defined results: a text that is null, empty, or not given back by both tokenizers has zeros and ''; rows that repeat, in all columns or in doc_id only, are
reported and counted one by one; ties for a B id's highest count are all best; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, small_batches, store

#: B ids are dealt to so many stripes; a stripe's matrix has (B ids / STRIPES) x A ids counts of 8 bytes, 101 MB for 32,000 x 50,257.
STRIPES = 128
#: Characters of text in a batch of documents; a longer document is a batch of its own.
BATCH_CHARS = 1 << 20
#: Distinct chunks, and characters of them, that a worker remembers from batch to batch; then it starts anew.
MEMO_CHUNKS, MEMO_CHARS = 150_000, 1 << 22
#: Distinct pairs that a task adds up before it sends them on.
PAIRS = 1_000_000
#: Batches of documents that one task scores against a stripe.
SALT_BATCHES = 8192
#: Batches, of a megabyte or three each, that one task puts together with their scores.
JOIN_BATCHES = 8

_SPACES = re.compile(r"(?<=\S) (?=\S)")
_TWO = re.compile(r"\s\s")
_LINKS = "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, first array<int>, chunk array<int>, chunk_first array<int>, pair array<int>, b array<int>, a array<int>, n array<long>"
_COUNTS = "stripe int, b array<int>, a array<int>, n array<long>, best array<boolean>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, the others in order from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = _byte_table()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        # each id as text with what may follow it: a comma or, after the last one of a group's side, a bar or semicolon; a line ends a chunk
        self.names = [f"{i}{c}" for side, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;\n")) for c in marks for i in range(len(side))]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)], self.b.encode(chunks, num_threads=1)

    def lost(self, chunks: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[int]:
        """The places of chunks whose bytes either side doesn't give back."""
        raw = [(" " + c).encode() for c in chunks]
        sides = [(self.bytes_a, ids_a), (self.bytes_b, ids_b)]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        whole, bad = b"".join(raw), np.zeros(len(raw), dtype=bool)
        for table, ids in sides:
            back = [b"".join(map(table.__getitem__, i)) for i in ids] if len(ids) < 2 else None
            if back is None:
                n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                flat = list(map(table.__getitem__, chain.from_iterable(ids)))
                ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)))])[np.cumsum(n)]
                if (np.diff(ends, prepend=0) == size).all() and b"".join(flat) == whole:
                    continue
                back = [b"".join(map(table.__getitem__, i)) for i in ids]
            bad |= np.array([x != y for x, y in zip(back, raw, strict=True)])
        return np.flatnonzero(bad).tolist()


class Aligned:
    """Chunks that were seen, by number: token counts, groups as text, and links as codes b * (A ids) + a."""

    def __init__(self, pair: Pair):
        self.pair, self.width = pair, len(pair.bytes_a)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        self.chars, self.groups, self.stats, self.sizes, self.codes = 0, [], [], [], []
        self.none = set()  # numbers of chunks that aren't given back

    def _add(self, chunks: list[str], to: dict[str, int]) -> None:
        ids_a, ids_b = self.pair.encode(chunks)
        first = len(self.groups)
        to.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))
        for i in self.pair.lost(chunks, ids_a, ids_b):
            self.none.add(first + i)
            ids_a[i], ids_b[i] = [], []
        counts_a, counts_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum())) for ids, n in ((ids_a, counts_a), (ids_b, counts_b)))
        ends_a, ends_b = np.cumsum(self.pair.size_a[a]), np.cumsum(self.pair.size_b[b])
        ends = np.union1d(ends_a, ends_b)
        on_a, on_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        owner = np.repeat(np.arange(len(chunks)), counts_a)[on_a]
        links = np.bincount(owner, minlength=len(chunks))
        both = (ends_a[on_a] == ends) & (ends_b[on_b] == ends) if len(ends) else np.zeros(0, dtype=bool)
        groups = np.bincount(owner[both], minlength=len(chunks))
        self.stats.append(np.stack([counts_a, counts_b, groups, links], axis=1))
        self.sizes.append(links)
        self.codes.append(b[on_b] * self.width + a[on_a])
        self.groups += self._texts(a, b, on_a[both], on_b[both], counts_b)

    def _texts(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, counts_b: np.ndarray) -> list[bytes]:
        """The groups of each chunk, from the places of the last token of either side in every group."""
        if not len(b):
            return [b""] * len(counts_b)
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        mark_a[last_a] = mark_b[last_b] = 1
        full = counts_b > 0
        mark_b[np.cumsum(counts_b)[full] - 1] = 2
        name = np.concatenate([a + mark_a * self.width, b + mark_b * len(self.pair.bytes_b) + 2 * self.width])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        made = iter("".join(map(self.pair.names.__getitem__, name[order].tolist())).encode().split(b"\n"))
        return [next(made) if f else b"" for f in full.tolist()]

    def texts(self, texts: list[str]) -> list[list[int]]:
        """The chunk numbers of each text: none for texts without tokens."""
        cut = [_SPACES.split(t) if t[0].isspace() or t[-1].isspace() or _TWO.search(t) else t.split(" ") for t in texts]
        new = [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in self.at]
        if new:
            self._add(new, self.at)
        out = [list(map(self.at.__getitem__, words)) for words in cut]
        if self.none:
            odd = [i for i, ids in enumerate(out) if not self.none.isdisjoint(ids)]
            new = [t for t in dict.fromkeys(texts[i] for i in odd) if t not in self.whole]
            if new:
                self._add(new, self.whole)
            for i in odd:
                n = self.whole[texts[i]]
                out[i] = [] if n in self.none else [n]
        return out

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all chunks: counts, where their links begin, links."""
        self.stats, self.sizes, self.codes = [np.concatenate(self.stats)], [np.concatenate(self.sizes)], [np.concatenate(self.codes)]
        return self.stats[0], np.concatenate([[0], np.cumsum(self.sizes[0])]), self.codes[0]


def _one(values, kind: pa.DataType) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + size[0] - 1, first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _by_stripe(code: np.ndarray, width: int) -> np.ndarray:
    """The order of codes by stripe, then by code."""
    return np.lexsort((code, code // width % STRIPES))


def _linked(batch: int, doc_ids: list, texts: list[str], aligned: Aligned) -> pa.RecordBatch:
    full = [i for i, t in enumerate(texts) if t]
    found = dict(zip(full, aligned.texts([texts[i] for i in full]), strict=True))
    ids = [found.get(i, []) for i in range(len(texts))]
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    seq = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes.sum()))
    sha = [hashlib.sha256(b";".join([aligned.groups[c] for c in x])).hexdigest() if x else "" for x in ids]
    stats, begin, codes = aligned.flat() if len(aligned.groups) else (np.zeros((0, 4), dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64))
    times = np.bincount(seq, minlength=len(stats))
    used = np.flatnonzero(times)
    place = np.zeros(len(stats), dtype=np.int64)
    place[used] = np.arange(len(used))
    each = begin[used + 1] - begin[used]
    own = codes[_ranges(begin[used], each)]
    distinct, pair = np.unique(own, return_inverse=True)
    n = np.bincount(pair, weights=np.repeat(times[used], each), minlength=len(distinct)).astype(np.int64)
    order = _by_stripe(distinct, aligned.width)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    total = np.zeros((len(ids), 4), dtype=np.int64)
    np.add.at(total, np.repeat(np.arange(len(ids)), sizes), stats[seq])
    distinct, n = distinct[order], n[order]
    columns = [
        pa.array([batch], pa.int64()),
        _one(doc_ids, pa.int64()),
        *(_one(total[:, k], pa.int64()) for k in range(4)),
        _one(sha, pa.string()),
        _one(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
        _one(place[seq], pa.int32()),
        _one(np.concatenate([[0], np.cumsum(each)]), pa.int32()),
        _one(back[pair], pa.int32()),
        _one(distinct // aligned.width, pa.int32()),
        _one(distinct % aligned.width, pa.int32()),
        _one(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _LINKS.split(", ")])


def _link_batches(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligned, number, part = Aligned(Pair(path_a, path_b)), 0, TaskContext.get().partitionId() << 32
        ids, texts, chars = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal ids, texts, chars, number
            made = _linked(part + number, ids, texts, aligned)
            if len(aligned.groups) > MEMO_CHUNKS or aligned.chars > MEMO_CHARS:
                aligned.clear()
            number, ids, texts, chars = number + 1, [], [], 0
            return made

        for rows in batches:
            for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"], strict=True):
                t = text.as_py() or ""
                if chars and chars + len(t) > BATCH_CHARS:
                    yield out()
                ids.append(doc_id)
                texts.append(t)
                chars += len(t) + 1
        if ids:
            yield out()

    return run


def _summed(width: int):
    """Adds up pairs per task and deals them by stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            order = _by_stripe(code, width)
            c, m = code[order], n[order]
            stripe, first = np.unique(c // width % STRIPES, return_index=True)
            ends = pa.array(np.append(first, len(c)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, k)) for v, k in ((c // width, pa.int32()), (c % width, pa.int32()), (m, pa.int64()))]
            if len(stripe):
                yield pa.RecordBatch.from_arrays([pa.array(stripe, pa.int32()), *lists], names=["stripe", "b", "a", "n"])

        for rows in batches:
            b, a, m = (rows[k].flatten().to_numpy(zero_copy_only=False) for k in ("b", "a", "n"))
            both = np.concatenate([code, b.astype(np.int64) * width + a])
            code, at = np.unique(both, return_inverse=True)
            total = np.zeros(len(code), dtype=np.int64)
            np.add.at(total, at, np.concatenate([n, m]))
            n = total
            if len(code) > PAIRS:
                yield from out()
                code, n = code[:0], n[:0]
        yield from out()

    return run


def _rows_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list]:
    """Rows of scalars and numpy arrays."""
    for rows in batches:
        for i in range(rows.num_rows):
            cells = [rows[k][i] for k in names]
            yield [c.values.to_numpy(zero_copy_only=False) if isinstance(c, pa.ListScalar) and c.is_valid else None if isinstance(c, pa.ListScalar) else c.as_py() for c in cells]


def _counted(width: int, height: int):
    """Whole stripes, one after the other: np.add.at into a stripe's dense matrix, row maxima, and the counts that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((-(-height // STRIPES), width), dtype=np.int64)
        at, last = [], None

        def out() -> pa.RecordBatch:
            cells = np.unique(np.concatenate(at))
            row, a = cells // width, cells % width
            n = block.ravel()[cells]
            top = np.zeros(len(block), dtype=np.int64)
            for r in np.unique(row):
                top[r] = block[r].max()
            block.ravel()[cells] = 0
            columns = [pa.array([last], pa.int32()), _one(row * STRIPES + last, pa.int32()), _one(a, pa.int32()), _one(n, pa.int64()), _one(n == top[row], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["stripe", "b", "a", "n", "best"])

        for stripe, b, a, n in _rows_of(batches, ("stripe", "b", "a", "n")):
            if stripe != last and at:
                yield out()
                at = []
            last = stripe
            row = b // STRIPES
            np.add.at(block, (row, a), n)
            at.append(row.astype(np.int64) * width + a)
            if len(at) > 64:
                at = [np.unique(np.concatenate(at))]
        if at:
            yield out()

    return run


def _scored(width: int, height: int):
    """Of each stripe its counts first, then the pairs of every batch, which take theirs from the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((-(-height // STRIPES), width), dtype=np.int64)
        last, cells = None, None
        for stripe, salt, batch, b, a, n, best in _rows_of(batches, ("stripe", "salt", "batch", "b", "a", "n", "best")):
            if batch is None:
                if (stripe, salt) != last and cells is not None:
                    block[cells] = 0
                last, cells = (stripe, salt), (b // STRIPES, a)
                block[cells] = 2 * n + best
                continue
            found = block[b // STRIPES, a]
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([stripe], pa.int32()), _one(found >> 1, pa.int64()), _one((found & 1).astype(bool), pa.bool_())], names=["batch", "stripe", "count", "best"])

    return run


def _striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's pairs, which lie in the order of stripes, as a row for each stripe."""
    for batch, b, a in _rows_of(batches, ("batch", "b", "a")):
        stripe, first = np.unique(b % STRIPES, return_index=True)
        if len(stripe):
            ends = pa.array(np.append(first, len(b)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stripe), batch), pa.int64()), pa.array(stripe, pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (b, a))], names=["batch", "stripe", "b", "a"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for i in range(rows.num_rows):
            row = {k: rows[k][i] for k in rows.schema.names}
            parts = sorted(row["scores"].as_py() or [], key=lambda s: s["stripe"]) if row["scores"].is_valid else []
            count = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(s["count"], dtype=np.int64) for s in parts)])
            best = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(s["best"], dtype=np.int64) for s in parts)])
            get = lambda k, row=row: row[k].values.to_numpy(zero_copy_only=False)
            first, chunk, chunk_first, pair = (get(k) for k in ("first", "chunk", "chunk_first", "pair"))
            of_doc = []
            for v in (best, count):
                run = np.concatenate([[0], np.cumsum(v[pair])])
                run = np.concatenate([[0], np.cumsum((run[chunk_first[1:]] - run[chunk_first[:-1]])[chunk])])
                of_doc.append(pa.array(run[first[1:]] - run[first[:-1]], pa.int64()))
            own = [row[k].values for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*own, *of_doc, row["groups_sha256"].values], names=[x.split()[0] for x in _RESULT.split(", ")])


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Batches of documents: their counts and groups, their chunks, and each distinct pair of linked ids with its number in the batch."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_link_batches(path_a, path_b), _LINKS)


def pair_counts(batches: DataFrame, width: int, height: int) -> DataFrame:
    """By stripe of B ids: every pair of ids that is linked somewhere, its number, and whether no A id has more links with that B id."""
    summed = batches.select("b", "a", "n").mapInArrow(_summed(width), "stripe int, b array<int>, a array<int>, n array<long>")
    return summed.repartition(STRIPES, "stripe").sortWithinPartitions("stripe").mapInArrow(_counted(width, height), _COUNTS)


def best_pairs(counts: DataFrame) -> DataFrame:
    """(b_id, a_id, n_links): for each B id that is linked at all the A id, or ids, it is linked with most often."""
    rows = counts.select(F.explode(F.arrays_zip("b", "a", "n", "best")).alias("x")).where("x.best")
    return rows.select(F.col("x.b").alias("b_id"), F.col("x.a").alias("a_id"), F.col("x.n").alias("n_links"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are their B id's best, the sum of the links' counts, and a digest of the groups."""
    pair = Pair(path_a, path_b)
    width, height = len(pair.bytes_a), len(pair.bytes_b)
    batches = store(links(docs, path_a, path_b), "alignment-links", large=True)
    counts = store(pair_counts(batches, width, height), "alignment-counts", large=True)
    n = batches.count()
    salts, tasks = -(-n // SALT_BATCHES) or 1, -(-n // JOIN_BATCHES) or 1
    own = batches.select("batch", "b", "a").mapInArrow(_striped, "batch long, stripe int, b array<int>, a array<int>")
    own = own.select("stripe", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int").alias("salt"), "batch", "b", "a", F.lit(None).cast("array<long>").alias("n"), F.lit(None).cast("array<boolean>").alias("best"))
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("batch"), "b", "a", "n", "best")
    both = known.unionByName(own).repartition(STRIPES * salts, "stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("batch").asc_nulls_first())
    scores = both.mapInArrow(_scored(width, height), "batch long, stripe int, count array<long>, best array<boolean>")
    scores = scores.repartition(tasks, "batch").groupBy("batch").agg(F.collect_list(F.struct("stripe", "count", "best")).alias("scores"))  # STRIPES at most
    rest = batches.select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "chunk", "chunk_first", "pair").repartition(tasks, "batch")  # so many tasks as batches ask for: their memory does not grow with the table
    out = store(rest.join(scores, "batch", "left").drop("batch").mapInArrow(_totals, _RESULT), "alignment")
    discard(batches, counts)
    return out
