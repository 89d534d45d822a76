"""MPEG transport streams as media columns: multiplexing bytes, and parsing streams back.

A payload is carried as 8-bit mono samples at 8 kHz in a private elementary stream: one PES packet
for each access unit, a presentation time stamp on each, and a random-access point with a clock
reference on every fourth.  The parser follows the program tables, checks the continuity counters,
reassembles the elementary packets and keeps the time stamps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Fixed values of ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
PRIVATE_STREAM_1 = 0xBD
STREAM_TYPE_PRIVATE_PES = 0x06
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

PMT_PID = 0x1000
DATA_PID = 0x0100
PROGRAM = 1
UNIT = 2048
SAMPLE_RATE = 8_000
RANDOM_ACCESS_EVERY = 4
PAD = 64


class StreamError(ValueError):
    """The bytes are no whole transport stream."""


@lru_cache(maxsize=256)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(
    PMT_PID,
    _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE_PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload`` (any bytes, also none)."""
    out = [PAT, PMT]
    counter = 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = at * CLOCK // SAMPLE_RATE % 2**33
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        sent = 0
        while sent < len(pes):
            first = sent == 0
            field_ = b""
            if first and n % RANDOM_ACCESS_EVERY == 0:
                field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            part = pes[sent : sent + room]
            spare = room - len(part)
            if spare and not field_:
                spare -= 1
                field_ = b"\x00" if spare else b""
                stuffing = bytes([len(field_) + max(spare - 1, 0)]) + field_ + b"\xff" * max(spare - 1, 0)
            elif field_:
                stuffing = bytes([len(field_) + spare]) + field_ + b"\xff" * spare
            else:
                stuffing = b""
            head = bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if stuffing else 0x10) | counter])
            out.append(head + stuffing + part)
            counter = counter + 1 & 15
            sent += len(part)
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its bytes, and for each access unit where it begins, its time and whether it is a random-access point."""

    pid: int
    kind: int
    data: bytes = b""
    offsets: list[int] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0


def _sections(held: bytearray, payload: bytes, begins: bool, table_id: int) -> list[bytes]:
    """The whole sections that ``payload`` completes; what is left of one that goes on waits in ``held``.

    Where sections begin, the first byte says how many bytes still belong to the one before.
    """
    if begins:
        start = 1 + payload[0]
        pieces = [bytes(held) + payload[1:start] if held else b"", payload[start:]]
    else:
        pieces = [bytes(held) + payload if held else b""]
    found, at, piece = [], 0, b""
    for piece in pieces:
        at = 0
        while at + 3 <= len(piece) and piece[at] != 0xFF:
            size = 3 + (int.from_bytes(piece[at + 1 : at + 3], "big") & 0x0FFF)
            if at + size > len(piece):
                break
            section = piece[at : at + size]
            if crc32_mpeg(section):
                raise StreamError("damaged program table")
            if section[0] == table_id:
                found.append(section)
            at += size
    held[:] = b"" if piece[at : at + 1] == b"\xff" else piece[at:]
    return found


def parse(media: bytes) -> list[Stream]:
    """The elementary streams of ``media``, in the order of the program tables.

    Raises StreamError where packets, tables or elementary packets are damaged.  Tables may run over
    several packets.  A jump of a continuity counter is counted; a repeated packet is skipped, and so
    is what comes before the first start of an elementary packet.  No packets, or no program: no streams.
    """
    if len(media) % PACKET:
        raise StreamError("not a whole number of packets")
    streams: dict[int, Stream] = {}
    tables: dict[int, int] = {}
    held: dict[int, bytearray] = {}
    counters: dict[int, int] = {}
    units: dict[int, list[list[bytes]]] = {}
    view = memoryview(media)
    for at in range(0, len(media), PACKET):
        if view[at] != SYNC or view[at + 1] & 0x80:
            raise StreamError(f"no packet at {at}")
        pid = (view[at + 1] & 0x1F) << 8 | view[at + 2]
        begins, control, counter = bool(view[at + 1] & 0x40), view[at + 3] >> 4 & 3, view[at + 3] & 15
        body, random_access = at + 4, False
        if control & 2:
            random_access = view[body] > 0 and bool(view[body + 1] & 0x40)
            body += 1 + view[body]
            if body > at + PACKET:
                raise StreamError(f"adaptation field beyond the packet at {at}")
        if not control & 1 or body == at + PACKET:
            continue
        payload = view[body : at + PACKET]
        if pid == PAT_PID or pid in tables:
            for section in _sections(held.setdefault(pid, bytearray()), bytes(payload), begins, 0 if pid == PAT_PID else 2):
                if pid == PAT_PID:
                    entries = [(int.from_bytes(section[i : i + 2], "big"), int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(section) - 4, 4)]
                    tables |= {place: program for program, place in entries if program}  # program 0 names the network table
                    continue
                i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                while i + 5 <= len(section) - 4:
                    own = int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF
                    streams.setdefault(own, Stream(own, section[i]))
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)
        elif (stream := streams.get(pid)) is not None:
            stream.packets += 1
            if pid in counters and counter != counters[pid] + 1 & 15:
                if counter == counters[pid]:
                    continue
                stream.discontinuities += 1
            counters[pid] = counter
            if begins:
                units.setdefault(pid, []).append([])
                stream.random_access.append(random_access)
            if pid in units:
                units[pid][-1].append(payload)
    for pid, parts in units.items():
        _reassemble(streams[pid], parts)
    return list(streams.values())


def _reassemble(stream: Stream, units: list[list[bytes]]) -> None:
    """The elementary packets of ``units``; a length of zero (allowed for video) means up to the next start.

    A packet without a time stamp has that of the packet before.
    """
    data, length = [], 0
    for unit in units:
        pes = b"".join(unit)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or int.from_bytes(pes[4:6], "big") not in (0, len(pes) - 6):
            raise StreamError("damaged elementary packet")
        stamped = bool(pes[7] & 0x80)
        if 9 + pes[8] > len(pes) or stamped and pes[8] < 5 or not (stamped or stream.pts):
            raise StreamError("damaged elementary packet")
        stream.pts.append(_read_stamp(pes[9:14]) if stamped else stream.pts[-1])
        stream.offsets.append(length)
        data.append(pes[9 + pes[8] :])
        length += len(data[-1])
    stream.data = b"".join(data)


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a transport stream of the padded UTF-8 text) of each row.

    A null or empty text is 64 zero bytes.  Repeated rows each give a row, equal texts equal streams.
    """
    small_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [r or b"" for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([mux(padded(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(store, f"doc_id {kind}, n_bytes bigint, media binary")


def _first_stream(media: bytes | None) -> tuple[Stream | None, str | None]:
    """The first elementary stream of ``media``, or why there is none."""
    if media is None:
        return None, None
    try:
        streams = parse(media)
    except StreamError as reason:
        return None, str(reason)
    return (streams[0], None) if streams else (None, "no program")


UNITS = "array<struct<offset: bigint, pts: bigint, random_access: boolean>>"


def read_media(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with what its first elementary stream holds.

    Adds payload, pid, packets, discontinuities, units (an entry for each access unit with its
    offset, time stamp and whether it is a random-access point) and error.  A null stream gives
    nulls; one that is damaged or has no program gives nulls and the reason in ``error``, and the
    other rows are read all the same.  Repeated rows each give a row; no rows, no rows.
    """
    units = pa.list_(pa.struct([("offset", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read_ = [_first_stream(m) for m in batch.column(2).to_pylist()]
            found = [s for s, _ in read_]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([s and s.data for s in found], pa.binary()),
                    *[pa.array([s and getattr(s, x) for s in found], pa.int64()) for x in ("pid", "packets", "discontinuities")],
                    pa.array([s and [{"offset": o, "pts": p, "random_access": r} for o, p, r in zip(s.offsets, s.pts, s.random_access, strict=True)] for s in found], units),
                    pa.array([e for _, e in read_], pa.string()),
                ],
                ["doc_id", "n_bytes", "media", "payload", "pid", "packets", "discontinuities", "units", "error"],
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {kind}, n_bytes bigint, media binary, payload binary, pid bigint, packets bigint, discontinuities bigint, units {UNITS}, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, spec)


def op3_transport_stream(docs: DataFrame) -> DataFrame:
    """Digests of the streams that hold the documents, and of what is read back from them.

    Null and empty texts are 64 zero bytes; repeated rows, also of one doc_id or none, each give a
    row; columns besides doc_id and text are not looked at; no rows, no rows.
    """
    back = read_media(to_media(docs))
    points = F.filter("units", lambda u: u.random_access)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("pid="), F.col("pid")), F.concat(F.lit("packets="), F.col("packets")), F.concat(F.lit("discontinuities="), F.col("discontinuities")),
        F.concat(F.lit("units="), F.size("units")), F.concat(F.lit("last_pts="), F.element_at("units", -1).pts),
        F.concat(F.lit("random_access="), F.array_join(F.transform(points, lambda u: F.concat(u.pts.cast("string"), F.lit("@"), u.offset.cast("string"))), "|")),
    )
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -PAD, PAD)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def brute_force(text: str | None) -> tuple:
    """What the contract asks for of one text, by plain means; for tests."""
    raw = (text or "").encode()
    whole = padded(raw)
    return len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-PAD:])
