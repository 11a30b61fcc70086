"""Ogg bitstreams in a binary column: pages, checksums, lacing, logical streams, granule times.

Writing makes one physical stream of two logical ones: ``pcm8`` holds the payload as 8-bit samples,
one packet for each frame of ``FRAME`` samples, and ``note`` holds the number of unpadded bytes.
Pages of ``pcm8`` are filled up to ``SEGMENTS`` lacing values, so packets go on over pages, and the
pages of ``note`` lie between them.
Reading verifies every page's checksum and sequence number, joins packets over lacing values and
pages, parts the logical streams by serial number, and turns granule positions into seconds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, RATE, SEGMENTS = 576, 48_000, 8
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
#: Each byte with its bits reversed.
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, from 0, not reflected).

    It is the mirror image of the reflected CRC that zlib has, fed with mirrored bytes and freed
    of zlib's inversions.
    """
    reflected = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_MIRROR), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing))
    whole = b"".join((head, lacing, body))
    return b"".join((head[:22], checksum(whole).to_bytes(4, "little"), head[26:], lacing, body))


def packet_lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def write(payload: bytes, n_bytes: int, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A physical stream of ``payload``, whose length is a multiple of ``frame``."""
    serial = zlib.crc32(payload)
    other = serial ^ 1
    opening = b"pcm8" + struct.pack("<IH", rate, frame)
    note = struct.pack("<Q", n_bytes)
    pages = [
        page(FIRST, 0, serial, 0, packet_lacing(len(opening)), opening),
        page(FIRST, 0, other, 0, packet_lacing(4), b"note"),
    ]
    each = packet_lacing(frame)
    lacing = each * (len(payload) // frame)
    begin = done = 0
    numbers = range(0, len(lacing), SEGMENTS)
    for number, at in enumerate(numbers, 1):
        own = lacing[at : at + SEGMENTS]
        stop = begin + sum(own)
        complete = (at + len(own)) // len(each)
        kind = (CONTINUED if at % len(each) else 0) | (LAST if at == numbers[-1] else 0)
        # a page on which no packet ends has no time
        pages.append(page(kind, complete * frame if complete > done else -1, serial, number, own, payload[begin:stop]))
        if number == (len(numbers) + 1) // 2:
            pages.append(page(LAST, len(payload), other, 1, packet_lacing(len(note)), note))
        begin, done = stop, complete
    return b"".join(pages)


@dataclass
class Stream:
    """A logical stream: its packets, and (granule, packets complete so far) of each page."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] | None = None

    def seconds(self, rate: int) -> list[float]:
        """The time at the end of each page that completes a packet."""
        return [g / rate for g, _ in self.granules if g >= 0]


def read(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number.  Raises OggError for anything that is not whole."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("a page's head is cut off")
        magic, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        stop = at + 27 + n + sum(lacing)
        if len(lacing) < n or stop > len(media):
            raise OggError("a page's body is cut off")
        if checksum(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : stop]))) != crc:
            raise OggError(f"the checksum of the page at byte {at} is wrong")
        s = streams.get(serial)
        if bool(kind & FIRST) != (s is None):
            raise OggError("a stream begins twice or not at all")
        if s is None:
            s = streams[serial] = Stream()
        if s.ended or number != s.pages or bool(kind & CONTINUED) != (s.open is not None):
            raise OggError("a page is missing or out of order")
        s.pages += 1
        place = at + 27 + n
        for value in _runs(lacing):
            size, whole = value
            part = media[place : place + size]
            place += size
            if s.open is not None:
                s.open.append(part)
                part = b"".join(s.open)
                s.open = None if whole else s.open
            elif not whole:
                s.open = [part]
            if whole:
                s.packets.append(part)
        s.granules.append((granule, len(s.packets)))
        s.ended = bool(kind & LAST)
        at = stop
    if any(s.open is not None or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def _runs(lacing: bytes) -> Iterator[tuple[int, bool]]:
    """(size, is it the packet's end) of each packet's part in a page."""
    size, inside = 0, False
    for v in lacing:
        size += v
        inside = v == 255
        if not inside:
            yield size, True
            size = 0
    if inside:
        yield size, False


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, int, int]:
    """Payload, unpadded bytes and sample rate of what ``write`` made."""
    sound = note = None
    for s in streams.values():
        head = s.packets[0] if s.packets else b""
        if head.startswith(b"pcm8") and len(head) == 10:
            sound = s
        elif head == b"note" and len(s.packets) == 2 and len(s.packets[1]) == 8:
            note = s
    if sound is None or note is None or len(sound.packets) < 2:
        raise OggError("a logical stream is missing")
    rate, frame = struct.unpack_from("<IH", sound.packets[0], 4)
    if not rate or any(len(p) != frame for p in sound.packets[1:]):
        raise OggError("a packet is no frame of samples")
    return b"".join(sound.packets[1:]), struct.unpack("<Q", note.packets[1])[0], rate


def padded(text: bytes, frame: int = FRAME) -> bytes:
    return text + b"\xff" * ((-len(text)) % frame if text else frame)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quillspark.llm._words import blocks, utf8

    for batch in batches:
        texts = [t or b"" for t in utf8(batch.column(1))]
        for i, j in blocks(texts, 4 << 20):
            media = [write(padded(t), len(t)) for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(media, pa.binary())], names=["doc_id", "media"])


def _features(payload: bytes, streams: dict[int, Stream], rate: int) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    whole = x[: len(x) // FRAME * FRAME]
    loudest = int(whole.reshape(-1, FRAME).sum(1).argmax()) if len(whole) else 0
    times = max((t for s in streams.values() for t in s.seconds(rate)), default=0.0)
    steps = int(np.abs(np.diff(x)).sum())
    return f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};ms={round(times * 1000)};sum={int(x.sum())};energy={int((x * x).sum())};steps={steps};peak={int(x.max())};loudest={loudest}"


_READ = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}


def _fields(media: bytes | None) -> tuple:
    """What a row of ``read_media`` says of a stream."""
    if media is None:
        return (None,) * 8
    size = len(media), hashlib.sha256(media).hexdigest()
    try:
        streams = read(media)
        payload, n, rate = payload_of(streams)
        feature = _features(payload, streams, rate)
    except OggError as e:
        return None, None, None, None, *size, None, str(e)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *size, feature, None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, *_fields(media)) for doc, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        cols = list(zip(*rows)) if rows else [[]] * len(_READ)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _READ.values())], names=list(_READ))


def text_to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text of ``docs`` (doc_id, text) as an Ogg stream.

    Null texts count as empty; an empty text is one frame of padding.  Equal texts have equal
    media.  Rows are handled one by one: repeats stay, null ids stay, an empty table gives an empty
    result, other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_write, "doc_id long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What the streams of ``media`` (doc_id, media) hold: sizes, digests and features.

    A stream that is not whole has its sizes, nulls and what is wrong with it in ``error``; null media
    have nulls in all.  Rows are read one by one: repeats and null ids stay; an empty table gives
    an empty result; other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(_read, schema)
