"""Media columns: signature sniffing, type correction, carving, and a lossless container for bytes as 8-bit samples.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value; a validator of the format then walks
its structure and returns the length that it proves, or nothing. What stands at the beginning decides the value's type, whatever
was declared; what stands elsewhere, outside of structures already proven, is carved.

Defined results: null bytes count as empty; a value without a proven structure keeps no type (null); overlapping candidates go to the
earlier one, then to the longer one; rows that repeat give equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

UNIT = 64
RATE = 8000


def _png(b: bytes, at: int) -> int:
    """Chunks with right checksums, from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    """Segments up to the scan, then to the end marker."""
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or kind < 0xC0:
            return 0
        frame |= kind in (0xC0, 0xC1, 0xC2)
        p += 2 + n
        if kind == 0xDA:
            while frame and (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
            if not frame or p < 0 or p + 1 >= len(b):
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    ok = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= pixels <= size
    return size if ok and at + size <= len(b) else 0


def _riff(form: bytes, need: bytes):
    def check(b: bytes, at: int) -> int:
        if b[at + 8 : at + 12] != form:
            return 0
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        p, seen = at + 12, set()
        while p + 8 <= end <= len(b):
            n = int.from_bytes(b[p + 4 : p + 8], "little")
            seen.add(b[p : p + 4])
            p += 8 + n + n % 2
        return end - at if p == end <= len(b) and any(s.startswith(need) for s in seen) else 0

    return check


def _ogg(b: bytes, at: int) -> int:
    """Pages of one stream, from the one that begins it to the one that ends it."""
    p, first = at, True
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        flags, n = b[p + 5], b[p + 26]
        if first != bool(flags & 2):
            return 0
        p, first = p + 27 + n + sum(b[p + 27 : p + 27 + n]), False
        if p > len(b):
            return 0
        if flags & 4:
            return p - at
    return 0


def _mp4(b: bytes, at: int) -> int:
    """Boxes from ftyp on; there must be a moov."""
    p, seen = at, False
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not kind.isalnum() or (p == at) != (kind == b"ftyp"):
            break
        seen |= kind == b"moov"
        p += n
    return p - at if seen else 0


def _au(b: bytes, at: int) -> int:
    if at + 24 > len(b):
        return 0
    start, n, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    ok = 24 <= start <= 4096 and 1 <= code <= 27 and 1000 <= rate <= 400_000 and 1 <= channels <= 64 and n < 2**32 - 1
    return start + n if ok and at + start + n <= len(b) else 0


#: Magic bytes, where they stand in the file, type and validator.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WAVEfmt ", 8, "audio/wav", _riff(b"WAVE", b"data")),
    (b"WEBPVP8", 8, "image/webp", _riff(b"WEBP", b"VP8")),
    (b"OggS\0", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b".snd", 0, "audio/basic", _au),
)
_found = None


def _automaton():
    global _found
    if _found is None:
        import ahocorasick

        _found = ahocorasick.Automaton()
        for i, (magic, *_) in enumerate(MAGIC):
            _found.add_word(magic.decode("latin-1"), i)
        _found.make_automaton()
    return _found


def structures(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the proven structures that lie in no other one, in order."""
    seen, end = [], -1
    hits = sorted((stop + 1 - len(MAGIC[i][0]) - MAGIC[i][1], i) for stop, i in _automaton().iter(b.decode("latin-1")))
    k = 0
    while k < len(hits):
        at = hits[k][0]
        best = (0, "")
        while k < len(hits) and hits[k][0] == at:
            if at >= max(0, end):
                _, _, kind, check = MAGIC[hits[k][1]]
                best = max(best, (check(b, at), kind))
            k += 1
        if best[0]:
            seen.append((at, *best))
            end = at + best[0]
    return seen


def sniff(rows: DataFrame, content: str = "content", declared: str = "declared", key: str = "id") -> DataFrame:
    """Per row: key, declared, detected (type proven at the beginning), corrected, length (proven), carved (other structures: offset, length, type, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, said, value in zip(*(b.column(c).to_pylist() for c in ("key", "declared", "content")), strict=True):
                found = structures(value := value or b"")
                own = found[0] if found and found[0][0] == 0 else (0, 0, None)
                rest = [{"offset": at, "length": n, "type": kind, "content": value[at : at + n]} for at, n, kind in found if at]
                out.append({"key": k, "declared": said, "detected": own[2], "corrected": own[2] is not None and own[2] != said, "length": own[1], "carved": rest})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("declared", pa.string()), ("detected", pa.string()), ("corrected", pa.bool_()), ("length", pa.int64()), ("carved", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())])))]))

    small_batches(rows.sparkSession)
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(declared).cast("string").alias("declared"), F.col(content).cast("binary").alias("content"))
    return slim.mapInArrow(run, "key string, declared string, detected string, corrected boolean, length long, carved array<struct<offset: long, length: long, type: string, content: binary>>")


def to_wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono recording."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(stored: bytes) -> bytes:
    """The samples of a recording of the form above; ValueError if its structure isn't proven."""
    if _riff(b"WAVE", b"data")(stored, 0) != len(stored):
        raise ValueError("not a whole WAV file")
    p = 12
    while True:
        kind, n = struct.unpack_from("<4sI", stored, p)
        if kind == b"data":
            return stored[p + 8 : p + 8 + n]
        p += 8 + n + n % 2


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of the text and 0s up to a positive multiple of UNIT; and how many were the text's."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def features(stored: bytes) -> str:
    """Type and length as proven, statistics of the samples, and the structures embedded in them."""
    found = structures(stored)
    kind, length = (found[0][2], found[0][1]) if found and found[0][0] == 0 else ("unknown", 0)
    payload = from_wav(stored)
    sample = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(sample, minlength=256) / len(sample)
    share = share[share > 0]
    entropy = float(-(share * np.log2(share)).sum())
    crossings = int(np.count_nonzero(np.diff(sample >= 128)))
    embedded = structures(payload)
    text = f"{kind};length={length};rate={RATE};samples={len(sample)};mean={sample.mean():.6f};entropy={abs(entropy):.6f};peak={int(sample.max())};crossings={crossings};embedded={len(embedded)}"
    return text + "".join(f";{name}@{at}+{n}" for at, n, name in embedded)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of each row of docs (doc_id, text): its text as a recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [padded(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for stored in b.column("media").to_pylist():
                payload = from_wav(stored)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(stored)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return text_media(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
