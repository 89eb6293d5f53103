import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from larkspur.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def flac(frames=3, size=192, total=None):
    """Frames of one constant sample each."""
    info = struct.pack(">HH", size, size) + (0).to_bytes(3, "big") * 2 + ((44100 << 44) | (0 << 41) | (7 << 36) | (frames * size if total is None else total)).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\0" + (34).to_bytes(3, "big") + info + b"\x81" + (4).to_bytes(3, "big") + b"pad!"

    def crc(data, poly, bits):
        c = 0
        for x in data:
            c ^= x << (bits - 8)
            for _ in range(8):
                c = (c << 1) ^ poly if c >> (bits - 1) else c << 1
                c &= (1 << bits) - 1
        return c

    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x02, k])
        frame = head + bytes([crc(head, 0x07, 8)]) + bytes([0, 17 + k])
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def pdf(body=b""):
    head = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n" + body
    return head + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n" + str(len(head)).encode() + b"\n%%EOF"


FILES = {
    "image/png": png(),
    "image/gif": b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;",
    "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03x\x12\x34\xff\x00\x56\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0",
    "audio/wav": media.wav(b"x" * 191),
    "image/webp": b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
    "application/gzip": gzip.compress(b"hello" * 9),
    "application/zip": zipped(),
    "application/pdf": pdf(),
    "audio/ogg": b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc",
    "audio/flac": flac(),
    "video/mp4": box(b"ftyp", b"isom") + box(b"moov", b"x" * 9),
}


@pytest.mark.parametrize("kind", FILES)
def test_formats(kind):
    data = FILES[kind]
    assert media.sniff(data)[0] == kind
    assert (kind, 5, len(data)) in media.sniff(b"junk:" + data + b"tail")[1]
    if kind not in ("audio/ogg", "video/mp4"):
        assert media.sniff(data[: len(data) - 4])[0] is None


def test_chance_hits_count_for_nothing():
    assert media.sniff(b"BM GIF89a RIFF PK\x03\x04 %PDF- fLaC OggS\0 ftyp \xff\xd8\xff \x1f\x8b\x08") == (None, [])


def test_embedded_in_a_container():
    assert media.sniff(media.wav(png() + b"  ")) == ("audio/wav", [("image/png", 44, len(png()))])


def test_what_follows_is_carved():
    gif, one = FILES["image/gif"], FILES["application/zip"]
    for whole in (flac(), flac(total=0), pdf(), one):
        first, found = media.sniff(whole + gif + whole + b"tail" + gif)
        n, g = len(whole), len(gif)
        kind = {b"fL": "audio/flac", b"%P": "application/pdf", b"PK": "application/zip"}[whole[:2]]
        assert first == kind and found == [("image/gif", n, g), (kind, n + g, n), ("image/gif", 2 * n + g + 4, g)]
    assert media.sniff(pdf(body=pdf()))[0] == "application/pdf" and media.sniff(pdf(body=pdf()) + b"x")[1][0][:2] == ("application/pdf", len(b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"))
    broken = bytearray(flac())
    broken[-1] ^= 1
    assert media.sniff(bytes(broken)) == (None, []) and media.sniff(flac()[:-1])[0] is None and media.sniff(flac(total=9999))[0] is None


def test_time_is_in_proportion_to_the_bytes():
    began = time.process_time()
    for magic in (b"PK\x03\x04" + b"x" * 30, b"%PDF-1.4 startxref 7 %%EOF ", b"PK\x05\x06" + b"\0" * 18, b"fLaC", flac()[:50], b"\xff\xd8\xff\xe0"):
        media.sniff(magic * (600_000 // len(magic)))
    assert time.process_time() - began < 40


def test_column(spark):
    rows = [(1, "image/gif", FILES["image/png"]), (2, "image/png", FILES["image/png"]), (3, "text/plain", b"ab" + FILES["image/gif"]), (4, None, None), (5, "x", b""), (1, None, FILES["image/png"])]
    df = spark.createDataFrame(rows, "id long, declared_type string, data binary").selectExpr("*", "1 AS media_type", "2 AS embedded")
    got = sorted(media.sniffed(df).collect(), key=lambda r: (r["id"], r["declared_type"] or ""))
    assert [r["media_type"] for r in got] == ["image/png", "image/png", "image/png", None, None, None]
    assert [r["corrected"] for r in got] == [True, True, False, False, False, False]
    assert bytes(got[3]["carved"][0]) == FILES["image/gif"] and got[3]["embedded"][0]["offset"] == 2
    assert media.sniffed(df.where("false")).collect() == []


def described(pay):
    """The features by plain sums."""
    n, total = len(pay), sum(pay)
    hist = [0] * 8
    for x in pay:
        hist[x // 32] += 1
    cross = sum((x * n > total) != (y * n > total) for x, y in zip(pay, pay[1:]))
    var = (sum(x * x for x in pay) * n - total * total) * 10 // (n * n)
    return f"mean={total * 1000 // n};var={var};cross={cross};hist={'/'.join(str(h * 1000 // n) for h in hist)}"


def check(df, rows):
    got = sorted(media.text_media(df).collect(), key=lambda r: (repr(r["doc_id"]), r["payload_sha256"]))
    want, pads = [], {}
    for d, t in rows:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        pads[hashlib.sha256(pay).hexdigest()] = pay
        want.append((d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    assert [tuple(r)[:5] for r in got] == sorted(want, key=lambda r: (repr(r[0]), r[3]))
    assert all(r["payload_bytes"] % 192 == 0 and r["media_bytes"] == r["payload_bytes"] + 44 and r["media_type"] == "audio/wav" for r in got)
    for r in got:
        assert r["media_sha256"] == hashlib.sha256(media.wav(pads[r["payload_sha256"]])).hexdigest() and r["feature"] == described(pads[r["payload_sha256"]])
    assert len({(r["payload_sha256"], r["n_bytes"], r["media_sha256"], r["feature"]) for r in got}) == len({(t or "") for _, t in rows})


def test_documents(documents, texts):
    check(documents, list(texts.items()))


def test_nasty(nasty, nasty_rows, empty):
    check(nasty, [r[:2] for r in nasty_rows])
    assert media.text_media(empty).collect() == []


def test_samples_of_an_odd_payload():
    assert media.samples(media.wav(b"abc")) == b"abc"
    with pytest.raises(ValueError):
        media.samples(b"RIFF\0\0\0\0WAVE")
