import hashlib
import struct
import zlib

from sigspark.llm.media import features, from_wav, media_report, padded, sniff, structures, to_wav

DOCS = "doc_id long, text string, media string, n_bytes string"


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    return {
        "image/png": png(),
        "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 128, 0, 0) + bytes(6) + b"\x21\xf9\x04" + bytes(4) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0\x3b",
        "image/jpeg": b"\xff\xd8\xff\xe0\0\x10JFIF" + bytes(10) + b"\xff\xc0\0\x0b" + bytes(9) + b"\xff\xda\0\x08" + bytes(6) + b"\x12\xff\0\x34\xff\xd9",
        "image/bmp": b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28),
        "audio/wav": to_wav(b"abcd"),
        "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
        "audio/ogg": b"OggS\0\x02" + bytes(20) + b"\x01\x03abc" + b"OggS\0\x04" + bytes(20) + b"\x01\x02de",
        "video/mp4": struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov",
        "audio/basic": b".snd" + struct.pack(">IIIII", 24, 3, 2, 8000, 1) + b"abc",
    }


def test_every_format_is_proven_carved_and_refused_when_cut():
    for kind, value in samples().items():
        assert structures(value) == [(0, len(value), kind)], kind
        assert structures(b"text " + value + b" and " + value) == [(5, len(value), kind), (10 + len(value), len(value), kind)]
        assert structures(value[:-1]) == []
    bad = bytearray(png())
    bad[20] ^= 1
    assert structures(bytes(bad)) == []


def test_sniff_corrects_and_carves(spark):
    s = samples()
    rows = [("a", "image/png", s["image/gif"]), ("b", "image/png", s["image/png"]), ("c", "text/plain", b"BM GIF89a " + s["image/jpeg"] + b"!" + s["audio/wav"]), ("d", None, None), ("d", None, None)]
    got = sniff(spark.createDataFrame([(*r, 1) for r in rows], "id string, declared string, content binary, length int")).collect()
    got = {r["key"]: r for r in got}
    assert got["a"].detected == "image/gif" and got["a"].corrected and got["a"].length == len(s["image/gif"])
    assert got["b"].detected == "image/png" and not got["b"].corrected
    assert [(c.type, bytes(c.content)) for c in got["c"].carved] == [("image/jpeg", s["image/jpeg"]), ("audio/wav", s["audio/wav"])] and got["c"].detected is None
    assert got["d"].length == 0 and got["d"].carved == []


def test_round_trip_of_texts(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "x" * 65, "BM GIF89a \u0000 .snd", "long " * 100_000]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a", None, None)], DOCS).repartition(3)
    got = {r.doc_id: r for r in media_report(rows).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(to_wav(payload)).hexdigest() and r.media_bytes == len(payload) + 44
        assert padded(t) == (len(raw), payload) and from_wav(to_wav(payload)) == payload
    assert got[0].feature == got[1].feature and got[None].feature == got[2].feature == features(to_wav(padded("a")[1]))
    assert media_report(rows.limit(0)).collect() == []
