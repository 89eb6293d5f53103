"""Media columns by signature sniffing.

One Aho-Corasick pass over the bytes locates every magic number; the validator of its format then walks the structure
and confirms the lengths it gives, so that a chance hit in text counts for nothing. What is valid at the start corrects
the declared type; what is valid further on, and not inside another carved find, is carved, from inside the first file too.
What formats keep at their ends (directories of archives, cross references, ends of frames) is looked up once for a blob,
so that time stays in proportion to its bytes however many magic numbers it has.

Defined results: null and empty media have type None and no finds; bytes that no validator confirms keep no type
(media_type null) and their declared type stays uncorrected; of finds at one place the longest counts; repeated rows
sniff alike; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import by_batch, id_text, table, written

UNIT, RATE = 192, 8000


def _png(b: memoryview, at: int, seen: dict) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n = int.from_bytes(b[i : i + 4], "big")
        kind = bytes(b[i + 4 : i + 8])
        if i + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return 0


def _gif(b: memoryview, at: int, seen: dict) -> int:
    if at + 13 > len(b):
        return 0
    i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21 and i + 2 < len(b):
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i = blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: memoryview, at: int, seen: dict) -> int:
    i, scan = at + 2, False
    while i + 2 <= len(b):
        if b[i] != 0xFF:
            if not scan:
                return 0
            j = bytes(b[i : i + 65536]).find(b"\xff")
            i += j if j >= 0 else 65536
            continue
        m = b[i + 1]
        if m == 0xD9:
            return i + 2 - at if scan else 0
        if m == 0xFF:
            i += 1
        elif m == 0 or 0xD0 <= m <= 0xD7:
            if not scan:
                return 0
            i += 2
        else:
            n = int.from_bytes(b[i + 2 : i + 4], "big")
            if n < 2:
                return 0
            scan |= m == 0xDA
            i += 2 + n
    return 0


def _bmp(b: memoryview, at: int, seen: dict) -> int:
    if at + 30 > len(b):
        return 0
    n, zero, data, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    return n if not zero and header in (40, 52, 56, 108, 124) and 14 + header <= data <= n <= len(b) - at and planes == 1 and bits in (1, 4, 8, 16, 24, 32) else 0


def _riff(kind: bytes) -> Callable[[memoryview, int, dict], int]:
    def valid(b: memoryview, at: int, seen: dict) -> int:
        if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) != kind:
            return 0
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        if end > len(b):
            return 0
        i = at + 12
        while i + 8 <= end:
            n = int.from_bytes(b[i + 4 : i + 8], "little")
            i += 8 + n + n % 2
        return end - at if i in (end, end + 1) and end > at + 12 else 0

    return valid


def _gzip(b: memoryview, at: int, seen: dict) -> int:
    d = zlib.decompressobj(31)
    try:
        i = at
        while i < len(b) and not d.eof:
            d.decompress(b[i : i + 65536])
            i += 65536
    except zlib.error:
        return 0
    return min(i, len(b)) - len(d.unused_data) - at if d.eof else 0


def _zip(b: memoryview, at: int, seen: dict) -> int:
    """By the end records, each of which says where its archive starts."""
    if "zip" not in seen:
        ends, data = {}, b.obj
        e = data.find(b"PK\x05\x06")
        while e >= 0:
            if e + 22 <= len(data):
                size, start, note = struct.unpack_from("<IIH", data, e + 12)
                first = e - size - start
                if first >= 0 and data[e - size : e - size + 4] == b"PK\x01\x02" and e + 22 + note <= len(data):
                    ends.setdefault(first, e + 22 + note)
            e = data.find(b"PK\x05\x06", e + 4)
        seen["zip"] = ends
    return seen["zip"].get(at, at) - at


def _pdf(b: memoryview, at: int, seen: dict) -> int:
    """To the last end mark whose startxref points, from this start, to cross references."""
    if not bytes(b[at + 5 : at + 6]).isdigit():
        return 0
    if "pdf" not in seen:
        found = [(m.start(), min(int(m[1]), len(b)), m.end()) for m in _pdf_end.finditer(b.obj)]
        target = np.zeros(2 * len(b) + 1, bool)
        target[[m.start(1) for m in _pdf_target.finditer(b.obj)]] = True
        seen["pdf"] = (*(np.array([x[k] for x in found], np.int64) for k in range(3)), target)
    place, offset, end, target = seen["pdf"]
    k = int(np.searchsorted(place, at))
    good = np.flatnonzero(target[at + offset[k:]] & (at + offset[k:] < place[k:]))
    return int(end[k + good[-1]]) - at if len(good) else 0


_pdf_end = re.compile(rb"startxref\s{1,4}([0-9]{1,12})\s{1,4}%%EOF")
_pdf_target = re.compile(rb"(?:(?<!start)(?=xref\s)|(?<![0-9])(?=[0-9]{1,10} [0-9]{1,5} obj))()")


def _ogg(b: memoryview, at: int, seen: dict) -> int:
    i = at
    while i + 27 <= len(b) and bytes(b[i : i + 5]) == b"OggS\0":
        segments = b[i + 26]
        if i + 27 + segments > len(b):
            return 0
        n = 27 + segments + sum(b[i + 27 : i + 27 + segments])
        last = b[i + 5] & 4
        i += n
        if i > len(b):
            return 0
        if last:
            return i - at
    return 0


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> (bits - 1) else 0)) & ((1 << bits) - 1)
        out.append(x)
    return out


# Fixed values of FLAC: both polynomials, and block sizes by code (0: of the header's own bytes).
_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_FLAC_BLOCKS = [None, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]


def _flac_frame(b: memoryview, i: int) -> int:
    """Samples of the frame whose header is at i; 0 if none is."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8 or b[i + 3] & 1 or b[i + 3] >> 4 > 10:
        return 0
    code, rate = b[i + 2] >> 4, b[i + 2] & 15
    n = _FLAC_BLOCKS[code]
    lead = 8 - (b[i + 4] ^ 0xFF).bit_length()  # ones that lead the frame's number: its bytes, as in UTF-8
    if n is None or rate == 15 or lead in (1, 8):
        return 0
    j = i + 4 + max(1, lead)
    extra = {6: 1, 7: 2}.get(code, 0)
    end = j + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(b):
        return 0
    crc = 0
    for x in b[i:end]:
        crc = _CRC8[crc ^ x]
    return (n or int.from_bytes(b[j : j + extra], "big") + 1) if crc == b[end] else 0


def _flac(b: memoryview, at: int, seen: dict) -> int:
    """Metadata blocks, then frames: each ends where its checksum comes out and the next begins, the last at the number of samples told."""
    i, last = at + 4, 0
    if i + 38 > len(b) or b[i] & 0x7F or int.from_bytes(b[i + 1 : i + 4], "big") != 34:
        return 0
    least = int.from_bytes(b[i + 8 : i + 11], "big")
    total = int.from_bytes(b[i + 17 : i + 22], "big") & 0xFFFFFFFFF
    while not last:
        if i + 4 > len(b) or b[i] & 0x7F == 0x7F:
            return 0
        last = b[i] & 0x80
        i += 4 + int.from_bytes(b[i + 1 : i + 4], "big")
        if i > len(b):
            return 0
    so_far, end = 0, 0
    while n := _flac_frame(b, i):
        crc, j, done, first = 0, i, 0, 0
        for x in b[i : i + 40 * n + 64]:  # no frame is longer: eight channels of at most 33 bits
            crc = (crc << 8 ^ _CRC16[crc >> 8 ^ x]) & 0xFFFF
            j += 1
            if not crc and j - i >= max(least, 8):
                first = first or j
                if (total and so_far + n >= total) or _flac_frame(b, j) or j == len(b):
                    done = j
                    break
        done = done or (0 if total else first)  # the number of samples may be left open
        if not done:
            break
        i = end = done
        so_far += n
        if total and so_far >= total:
            break
    return end - at if end and (not total or so_far >= total) else 0


def _mp4(b: memoryview, at: int, seen: dict) -> int:
    i, kinds = at, set()
    while i + 8 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), bytes(b[i + 4 : i + 8])
        if n < 8 or i + n > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        i += n
    return i - at if {b"ftyp", b"moov"} <= kinds else 0


#: Type, magic bytes, where they stand in the file, validator (length of a valid file at a place, or 0; a dict for what is looked up once).
FORMATS: tuple[tuple[str, bytes, int, Callable[[memoryview, int, dict], int]], ...] = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("audio/wav", b"RIFF", 0, _riff(b"WAVE")),
    ("image/webp", b"RIFF", 0, _riff(b"WEBP")),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("audio/ogg", b"OggS\0", 0, _ogg),
    ("audio/flac", b"fLaC", 0, _flac),
    ("video/mp4", b"ftyp", 4, _mp4),
)


def _build() -> ahocorasick.Automaton:
    at: dict[str, list[int]] = {}
    for i, (_, magic, *_) in enumerate(FORMATS):
        at.setdefault(magic.decode("latin-1"), []).append(i)
    a = ahocorasick.Automaton()
    for magic, which in at.items():
        a.add_word(magic, (len(magic), which))
    a.make_automaton()
    return a


_magic = _build()


def sniff(data: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type that is valid at the start (it may be followed by other bytes), and (type, offset, length) of media embedded elsewhere."""
    view, found, seen = memoryview(data), [], {}
    for end, (n, which) in _magic.iter(data.decode("latin-1")):
        for i in which:
            kind, _, before, valid = FORMATS[i]
            at = end - n + 1 - before
            if at >= 0 and (size := valid(view, at, seen)):
                found.append((at, -size, kind))
    found.sort()
    first = next((k for at, _, k in found if at == 0), None)
    out, over = [], 1
    for at, size, kind in found:
        if at >= over:
            out.append((kind, at, -size))
            over = at - size
    return first, out


def sniffed(media: DataFrame) -> DataFrame:
    """media (id, declared_type, data) with media_type, corrected, embedded (type, offset, length of each find) and carved (their bytes)."""
    df = media.select(F.col("id").cast("long").alias("id"), F.col("declared_type").cast("string").alias("declared_type"), F.col("data").cast("binary").alias("data"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column("data").to_pylist()
        found = [sniff(d) if d else (None, []) for d in data]
        declared = batch.column("declared_type").to_pylist()
        kinds = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"), batch.column("declared_type"), pa.array([k for k, _ in found], pa.string()),
                pa.array([k is not None and k != d for (k, _), d in zip(found, declared)]),
                pa.array([[{"type": k, "offset": a, "length": n} for k, a, n in x] for _, x in found], kinds),
                pa.array([[d[a : a + n] for _, a, n in x] for d, (_, x) in zip(data, found)], pa.list_(pa.binary())),
            ],
            ["id", "declared_type", "media_type", "corrected", "embedded", "carved"],
        )

    return by_batch(df, run, "id long, declared_type string, media_type string, corrected boolean, embedded array<struct<type: string, offset: bigint, length: bigint>>, carved array<binary>")


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """Eight-bit mono samples; an odd payload gets the format's padding byte."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def samples(stored: bytes) -> bytes:
    """The data chunk of a WAV file."""
    i = 12
    while i + 8 <= len(stored):
        n = int.from_bytes(stored[i + 4 : i + 8], "little")
        if stored[i : i + 4] == b"data":
            return stored[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("no data chunk")


def features(payload: bytes) -> str:
    """Mean, spread, crossings of the mean and the shares of eight ranges of the samples."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    above = x.astype(np.int64) * n > total
    return f"mean={total * 1000 // n};var={(square * n - total * total) * 10 // (n * n)};cross={int((above[1:] != above[:-1]).sum())};hist={'/'.join(map(str, shares))}"


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file, written to the shared folder."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        media = [wav(r + b" " * (-len(r) % UNIT if r else UNIT)) for r in raw]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([*map(len, raw)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(by_batch(id_text(docs), run, "doc_id long, n_bytes long, media binary"), "media-stored")


def text_media(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Each text stored as a WAV file, read back from there, sniffed and described; declared is the type it comes with."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for n, stored in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
            kind, embedded = sniff(stored)
            if kind != "audio/wav":
                raise ValueError(f"stored as audio/wav, found {kind}")
            back = samples(stored)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back), kind, kind != declared, len(embedded)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_embedded long"
    names = [c.split()[0] for c in schema.split(", ")]
    return by_batch(stored_texts(docs), run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
