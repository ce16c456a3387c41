"""Media columns: what stored bytes really are, by magic bytes and structure, and media embedded in them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorewright.llm.common import slices


class Data(bytes):
    """Bytes that remember where needles come next, so that places asked for in rising order take one search in all."""

    def after(self, needle: bytes, at: int) -> int:
        """Where the needle begins at `at` or later, -1 if nowhere."""
        known = self.__dict__.setdefault("known", {})
        asked, found = known.get(needle, (len(self) + 1, 0))
        if not (asked <= at and (at <= found or found < 0)):
            known[needle] = at, (found := self.find(needle, at))
        return found


def _chain(b: Data, step: Callable[[Data, int], tuple[int, bool]], start: int) -> int:
    """Where a chain of blocks from `start` ends, 0 if it breaks off. step gives what follows a block (0: broken), and whether that is the end.

    What is found for a block is kept for all before it, so that chains which run into each other are walked once.
    """
    known = b.__dict__.setdefault(step.__name__, {})
    walked, here = [], start
    while here not in known:
        walked.append(here)
        after, ended = step(b, here)
        if ended or not after:
            known[here] = after
            break
        here = after
    for place in walked:
        known[place] = known[here]
    return known[here]


def _png_chunk(b: Data, at: int) -> tuple[int, bool]:
    if at + 12 > len(b):
        return 0, True
    size, kind = struct.unpack(">I4s", b[at : at + 8])
    if at + 12 + size > len(b) or zlib.crc32(b[at + 4 : at + 8 + size]) != struct.unpack(">I", b[at + 8 + size : at + 12 + size])[0]:
        return 0, True
    return at + 12 + size, kind == b"IEND"


def _png(b: Data, at: int) -> int:
    return max(_chain(b, _png_chunk, at + 8) - at, 0)


def _gif_colours(flags: int) -> int:
    return 3 << (flags & 7) + 1 if flags & 128 else 0


def _gif_block(b: Data, twice: int) -> tuple[int, bool]:
    """Blocks are at even numbers, twice their place; at odd ones are the parts of a block's data."""
    at, part = divmod(twice, 2)
    if at >= len(b):
        return 0, True
    if part:
        return 2 * (at + 1 + b[at]) + (b[at] > 0), False
    if b[at] == 0x3B:
        return 2 * (at + 1), True
    if b[at] == 0x21:
        return 2 * (at + 2) + 1, False
    if b[at] == 0x2C and at + 10 <= len(b):
        return 2 * (at + 11 + _gif_colours(b[at + 9])) + 1, False
    return 0, True


def _gif(b: Data, at: int) -> int:
    if len(b) < at + 13 or b[at + 3 : at + 6] not in (b"87a", b"89a"):
        return 0
    return max(_chain(b, _gif_block, 2 * (at + 13 + _gif_colours(b[at + 10]))) // 2 - at, 0)


def _jpeg_segment(b: Data, at: int) -> tuple[int, bool]:
    if b[at : at + 2] == b"\xff\xd9":
        return at + 2, True
    if at + 4 > len(b) or b[at] != 0xFF or (size := b[at + 2] << 8 | b[at + 3]) < 2:
        return 0, True
    after = at + 2 + size
    if b[at + 1] == 0xDA:  # coded data: on to the next marker that isn't stuffed or a restart
        after = b.find(b"\xff", after)
        while after >= 0 and after + 1 < len(b) and (b[after + 1] == 0 or 0xD0 <= b[after + 1] <= 0xD7):
            after = b.find(b"\xff", after + 2)
    return max(after, 0), after < 0


def _jpeg(b: Data, at: int) -> int:
    return max(_chain(b, _jpeg_segment, at + 2) - at, 0)


def _bmp(b: Data, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, reserved, offset, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes, bits = struct.unpack("<HH", b[at + 26 : at + 30])
    fits = 26 <= offset <= size <= len(b) - at
    return size if not reserved and header in (40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and fits else 0


def _riff(form: bytes) -> Callable[[Data, int], int]:
    def check(b: Data, at: int) -> int:
        if len(b) < at + 20 or b[at + 8 : at + 12] != form:
            return 0
        size = struct.unpack("<I", b[at + 4 : at + 8])[0] + 8
        end = at + 12
        while end + 8 <= at + size <= len(b):
            end += 8 + (n := struct.unpack("<I", b[end + 4 : end + 8])[0]) + n % 2
        return size if end == at + size else 0

    return check


def _pdf(b: Data, at: int) -> int:
    """To the last end mark before the next header: later versions of a file are appended to it, each with its own."""
    if (last := b.after(b"startxref", at)) < 0:
        return 0
    limit = b.after(b"%PDF-", at + 5)
    limit = len(b) if limit < 0 else limit
    if last > limit:
        return 0
    end = b.rfind(b"%%EOF", at, limit)
    return end + 5 - at if end > last else 0


def _gzip(b: Data, at: int) -> int:
    stream, here = zlib.decompressobj(31), at
    try:
        while here < len(b) and not stream.eof:
            left = b[here : here + (64 << 10)]
            here += len(left)
            while left and not stream.eof:
                stream.decompress(left, 1 << 20)  # what comes out is dropped
                left = stream.unconsumed_tail
    except zlib.error:
        return 0
    return here - len(stream.unused_data) - at if stream.eof else 0


def _zip(b: Data, at: int) -> int:
    end = b.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack("<IIH", b[end + 12 : end + 22])
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) and b[at + start : at + start + 4] == b"PK\x01\x02" else 0


def _ogg_page(b: Data, at: int) -> tuple[int, bool]:
    if at + 27 > len(b) or b[at : at + 5] != b"OggS\0":
        return 0, True
    n = b[at + 26]
    after = at + 27 + n + sum(b[at + 27 : at + 27 + n])
    return (after, b[at + 5] & 4 > 0) if after <= len(b) else (0, True)


def _ogg(b: Data, at: int) -> int:
    return max(_chain(b, _ogg_page, at) - at, 0)


# Magic bytes, the type they announce, and what confirms it.
FORMATS: list[tuple[bytes, str, Callable[[Data, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF8", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE")),
    (b"RIFF", "image/webp", _riff(b"WEBP")),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"OggS", "audio/ogg", _ogg),
]


def signatures():  # noqa: ANN201  an Aho-Corasick automaton over all magic bytes
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in {m for m, _, _ in FORMATS}:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff_bytes(data: bytes, automaton) -> list[tuple[str, int, int]]:  # noqa: ANN001
    """(type, offset, length) of all media in `data` whose structure holds, in order of offset; magic bytes inside them count too."""
    view, found = Data(data), []
    for last, magic in automaton.iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        for known, kind, check in FORMATS:
            if known == magic and (length := check(view, at)):
                found.append((kind, at, length))
    return found


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The bytes as 8-bit samples of one channel; an odd number gets the pad byte that the format asks for."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def wav_samples(data: bytes) -> bytes:
    """The samples of the first data chunk."""
    at = 12
    while at + 8 <= len(data):
        kind, n = struct.unpack("<4sI", data[at : at + 8])
        if kind == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return b""


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: int = 64) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text as UTF-8, padded with zeros to a positive multiple of `unit`, as a WAV of 8-bit samples.

    Null texts are empty: one unit of zeros. Every row gives one; an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            raw = pc.fill_null(batch.column(text_column).cast(pa.binary()), b"").to_pylist()
            media = [to_wav(x + b"\0" * (max(unit, -(-len(x) // unit) * unit) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return docs.select(id_column, text_column).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


SNIFFED = "media_type string, media_length long, corrected boolean, embedded array<struct<type: string, offset: long, length: long>>"


def sniff(df: DataFrame, media_column: str = "media", declared_column: str = "declared") -> DataFrame:
    """df with media_type, media_length, corrected and embedded; columns so named are replaced.

    The type is that of the media that begins at the first byte, else the declared one; corrected says that they
    differ. embedded lists all confirmed media elsewhere in the bytes, to be cut out by carve(). Null bytes have null
    type, length zero and nothing embedded; repeated rows are alike; an empty table stays empty.
    """
    kept = df.drop("media_type", "media_length", "corrected", "embedded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = signatures()
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))]
        for batch in slices(batches, media_column):
            rows = []
            for data, declared in zip(batch.column(media_column).to_pylist(), batch.column(declared_column).to_pylist(), strict=True):
                found = sniff_bytes(data, automaton) if data is not None else []
                whole = next((f for f in found if f[1] == 0), None)
                kind = whole[0] if whole else declared if data is not None else None
                rows.append((kind, whole[2] if whole else len(data or b""), kind != declared, [dict(zip(("type", "offset", "length"), f, strict=True)) for f in found if f[1]]))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=[*batch.schema.names, "media_type", "media_length", "corrected", "embedded"])

    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(SNIFFED).fields])
    return kept.mapInArrow(run, schema)


def carve(df: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """(id, type, offset, length, bytes): a row for each medium embedded in the rows of sniff().

    Rows without any, null bytes among them, give none; repeated rows give theirs each; an empty table gives none.
    """
    rows = df.selectExpr(id_column, media_column, "explode(embedded) AS e")
    return rows.selectExpr(id_column, "e.type", "e.offset", "e.length", f"substring({media_column}, cast(e.offset + 1 AS int), cast(e.length AS int)) AS bytes")


def describe(sniffed: DataFrame) -> DataFrame:
    """Digests of stored WAVs and of their samples, for rows of store_texts() after sniff().

    feature names the confirmed type, the number of samples, their mean and deviation, how often they change, and
    the embedded media. What is no WAV has no samples and is silent. Every row gives one, repeated rows alike; an
    empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, n, media, kind, embedded in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "media_type", "embedded")), strict=True):
                payload = wav_samples(media) if kind == "audio/wav" else b""
                x = np.frombuffer(payload, np.uint8)
                stats = f"mean={x.mean():.3f};std={x.std():.3f};changes={np.count_nonzero(x[1:] != x[:-1])}" if len(x) else "silent"
                inner = ",".join(f"{e['type']}@{e['offset']}+{e['length']}" for e in embedded)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind};samples={len(x)};{stats};embedded={inner}"))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return sniffed.select("doc_id", "n_bytes", "media", "media_type", "embedded").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
