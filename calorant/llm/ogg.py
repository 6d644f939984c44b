"""Ogg containers as a media column: write, verify, demultiplex and read back.

A payload is cut into packets of 576 samples (8 bits each), dealt in turn to two logical streams and
framed in pages of at most 255 lacing values. Reading verifies every page's checksum and sequence
number, reassembles packets from the lacing values, separates the logical streams by serial number
and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from calorant.llm.common import encoded

FRAME = 576
RATE = 8000
STREAMS = 2
SERIAL = 0x43410000
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_FIRST, _LAST, _CONTINUED = 2, 4, 1


def page_checksum(page: bytes) -> int:
    """The container's CRC-32: polynomial 0x04C11DB7, most significant bit first, start and final value 0.

    It is the mirrored CRC of zlib over mirrored bytes, with zlib's inversions undone.
    """
    got = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def lacing_values(size: int) -> bytes:
    """255 for each full segment, then the rest, which is 0 where the size is a multiple of 255."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(packets: list[bytes], serial: int, samples: int = FRAME) -> list[bytes]:
    """Pages of one logical stream. A page holds at most 255 lacing values; a packet may run on to the next."""
    pages, lacing, body, done, granule, flags = [], bytearray(), bytearray(), False, 0, _FIRST
    for packet in packets or [b""]:
        at = 0
        for value in lacing_values(len(packet)):
            if len(lacing) == 255:
                pages.append(_page(flags, granule if done else -1, serial, len(pages), bytes(lacing), bytes(body)))
                flags, done = _CONTINUED if at else 0, False
                lacing, body = bytearray(), bytearray()
            lacing.append(value)
            body += packet[at : at + value]
            at += value
        granule, done = granule + samples, True
    pages.append(_page(flags | _LAST, granule if packets else 0, serial, len(pages), bytes(lacing), bytes(body)))
    return pages


def write(payload: bytes, frame: int = FRAME, streams: int = STREAMS) -> bytes:
    """Payload as interleaved pages of logical streams, packets dealt in turn. Beginning pages come first."""
    packets = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    each = [stream_pages(packets[k::streams], SERIAL + k, frame) for k in range(streams)]
    out = []
    for n in range(max(map(len, each))):
        out += [pages[n] for pages in each if n < len(pages)]
    return b"".join(out)


def read(media: bytes) -> tuple[dict[int, dict], int]:
    """Logical streams by serial number (packets, granules, pages) and the number of pages.

    Raises ValueError on a bad capture pattern, checksum, page order or a packet without an end.
    """
    streams: dict[int, dict] = {}
    at = pages = 0
    while at < len(media):
        mark, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if len(page) != end - at or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"bad checksum in the page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "ends": [], "pages": 0, "part": b"", "open": False, "over": False})
        if sequence != s["pages"] or s["over"] or bool(flags & _FIRST) != (sequence == 0) or bool(flags & _CONTINUED) != s["open"]:
            raise ValueError(f"page {sequence} of stream {serial} is out of order")
        body, whole = at + 27 + n, 0
        for value in lacing:
            s["part"] += media[body : body + value]
            body += value
            s["open"] = value == 255
            if not s["open"]:
                s["packets"].append(s["part"])
                s["part"], whole = b"", whole + 1
        if whole:
            s["ends"].append((len(s["packets"]), granule))
        s["pages"], s["over"] = s["pages"] + 1, bool(flags & _LAST)
        at, pages = end, pages + 1
    if any(s["open"] or not s["over"] for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams, pages


def joined(streams: dict[int, dict]) -> bytes:
    """The payload: packets of all logical streams, taken in turn."""
    each = [streams[k]["packets"] for k in sorted(streams)]
    out = [b""] * sum(map(len, each))
    for k, packets in enumerate(each):
        out[k :: len(each)] = packets
    return b"".join(out)


def packet_times(stream: dict, rate: int = RATE) -> list[float]:
    """End time of each packet in seconds, interpolated between the granule positions of pages."""
    out, before, position = [], 0, 0
    for upto, granule in stream["ends"]:
        n = upto - before
        out += [(position + (granule - position) * (i + 1) / n) / rate for i in range(n)]
        before, position = upto, granule
    return out


def feature(streams: dict[int, dict], pages: int, rate: int = RATE) -> str:
    """Streams, pages, packets, and each stream's last granule position and duration in milliseconds."""
    last = [(s["ends"][-1][1] if s["ends"] else 0) for _, s in sorted(streams.items())]
    times = [packet_times(s, rate) for _, s in sorted(streams.items())]
    return (
        f"streams={len(streams)};pages={pages};packets={sum(len(s['packets']) for s in streams.values())};granules={'/'.join(map(str, last))};ms="
        + "/".join(str(round(1000 * t[-1])) if t else "0" for t in times)
    )


def padded(data: bytes, frame: int = FRAME) -> bytes:
    """Bytes 255 appended up to a positive multiple of frame."""
    return data + b"\xff" * (-len(data) % frame if data else frame)


def media_features(docs: DataFrame, frame: int = FRAME, streams: int = STREAMS, rate: int = RATE) -> DataFrame:
    """Store each text's bytes as a container, read the stored bytes back and describe them.

    A null text counts as empty: one packet of padding. Equal texts give equal values whatever their
    id; repeated rows stay. A text of any length is one container. An empty table gives no rows; other columns are ignored.
    """

    def describe(data: bytes) -> tuple:
        media = write(padded(data, frame), frame, streams)
        got, pages = read(media)
        back = joined(got)
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(got, pages, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for batch in batches:
            rows = [describe(data) for data in encoded(batch["text"])]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, FEATURES)
