"""MPEG transport streams as a media column.

``mux`` stores a payload as one program with one private data stream: PAT and PMT, then PES packets of ACCESS_UNIT bytes
with a timestamp each, cut into 188-byte packets with continuity counters; every RANDOM_ACCESS-th access unit is
a random-access point with its own clock reference and repeated tables. ``demux`` reads such bytes back: it parses the
program tables, checks continuity counters, reassembles the elementary packets and returns their timestamps, byte positions and
random-access points, of every elementary stream of every program. Packets sent twice count once, and a counter may jump
where a discontinuity is flagged. Both work on all packets of a stream at once.

Rows are independent, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.session import table

# Fixed values of the transport stream format and of the program that is written.
PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PROGRAM = 1
PRIVATE_TYPE = 0x06
PRIVATE_STREAM = 0xBD
PES_HEADER = 14
CLOCK = 90_000
FRAME_TICKS = 3_600
ACCESS_UNIT = 16_384
RANDOM_ACCESS = 4
PAYLOAD_UNIT = 64
#: Bytes of media in one output batch, so long as single streams are smaller.
BATCH_BYTES = 8 << 20


class StreamError(ValueError):
    """Bytes that aren't a whole transport stream."""


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        out.append(crc)
    return out


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC of program tables: polynomial 04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ CRC_TABLE[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = np.full(PACKET, 0xFF, np.uint8)
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    packet[: len(head) + len(section)] = np.frombuffer(head + section, np.uint8)
    return packet


def _tables() -> np.ndarray:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return np.stack([_table_packet(PAT_PID, pat), _table_packet(PMT_PID, pmt)])


TABLES = _tables()


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of PAYLOAD_UNIT."""
    return data + b"\0" * (max(PAYLOAD_UNIT, -(-len(data) // PAYLOAD_UNIT) * PAYLOAD_UNIT) - len(data))


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``, of at least one byte."""
    units = -(-len(payload) // ACCESS_UNIT)
    number = np.arange(units)
    size = np.full(units, ACCESS_UNIT)
    size[-1] = len(payload) - (units - 1) * ACCESS_UNIT

    head = np.zeros((units, PES_HEADER), np.uint8)
    head[:, 2:4] = 1, PRIVATE_STREAM
    head[:, 4], head[:, 5] = (size + 8) >> 8, (size + 8) & 0xFF
    head[:, 6:9] = 0x80, 0x80, 5
    pts = number * FRAME_TICKS % (1 << 33)
    for column, (shift, mask, marks) in enumerate([(29, 0x0E, 0x21), (22, 0xFF, 0), (14, 0xFE, 1), (7, 0xFF, 0)]):
        head[:, 9 + column] = (pts >> shift) & mask | marks
    head[:, 13] = (pts << 1) & 0xFE | 1

    # Where headers and payloads stand in the elementary stream.
    total = size + PES_HEADER
    starts = np.cumsum(total) - total
    stream = np.empty(int(total.sum()), np.uint8)
    is_head = np.zeros(len(stream), bool)
    is_head[(starts[:, None] + np.arange(PES_HEADER)).ravel()] = True
    stream[is_head], stream[~is_head] = head.ravel(), np.frombuffer(payload, np.uint8)

    # Packets: a random-access point spends 8 bytes of its first packet on its adaptation field.
    access = number % RANDOM_ACCESS == 0
    room = np.where(access, 176, 184)
    packets = 1 + np.maximum(0, -(-(total - room) // 184))
    n = int(packets.sum())
    first = np.cumsum(packets) - packets
    held = np.full(n, 184)
    held[first] = np.minimum(room, total)
    last = first + packets - 1
    several = packets > 1
    held[last[several]] = (total - room - (packets - 2) * 184)[several]
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[first, 1] |= 0x40
    field = 184 - held
    out[:, 3] = np.where(field > 0, 0x30, 0x10) | np.arange(n) % 16
    some = field > 0
    out[some, 4] = field[some] - 1
    out[field > 1, 5] = 0
    points = first[access]
    out[points, 5] = 0x50
    clock = pts[access]
    for column, shift in enumerate((25, 17, 9, 1)):
        out[points, 6 + column] = (clock >> shift) & 0xFF
    out[points, 10], out[points, 11] = (clock & 1) << 7 | 0x7E, 0
    out[np.arange(PACKET) >= (PACKET - held)[:, None]] = stream

    # Tables stand before each random-access point, with counters of their own.
    tables = np.repeat(TABLES[None], len(points), axis=0)
    tables[:, :, 3] |= (np.arange(len(points)) % 16)[:, None].astype(np.uint8)
    return np.insert(out, np.repeat(points, 2), tables.reshape(-1, PACKET), axis=0).tobytes()


@dataclass
class Stream:
    """What a transport stream holds."""

    program: int
    pid: int
    stream_type: int
    packets: int
    payload: bytes
    #: Of each elementary packet: its timestamp in ticks of 1/90000 s, and whether decoding can start there.
    timestamps: np.ndarray
    random_access: np.ndarray
    #: Of each elementary packet: where its first packet stands in the bytes of the stream.
    positions: np.ndarray
    continuity_errors: int


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    begin = (5 + int(packet[4]) if packet[3] & 0x20 else 4) + 0
    begin += 1 + int(packet[begin])
    data = packet.tobytes()
    length = int.from_bytes(data[begin + 1 : begin + 3], "big") & 0xFFF
    section = data[begin : begin + 3 + length]
    if section[0] != table_id or crc32_mpeg(section):
        raise StreamError("a program table is damaged, or longer than a packet")
    if section[7]:
        raise StreamError("a program table of several sections")
    return section


def demux(data: bytes) -> Stream:
    """Parse a transport stream of a single elementary stream; more than one and damage that hits its structure raise."""
    found = demux_all(data)
    if len(found) != 1:
        raise StreamError(f"{len(found)} elementary streams")
    return found[0]


def demux_all(data: bytes) -> list[Stream]:
    """Every elementary stream of a transport stream, in the order of its program tables; damage that hits its structure
    raises. Elementary packets need no timestamp (then -1), nor a length if they are video. Streams that are scrambled, have no
    packet, no optional header, several versions of a table or tables over a packet raise."""
    if not data or len(data) % PACKET:
        raise StreamError(f"{len(data)} bytes are not whole packets")
    packets = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise StreamError("a packet without sync byte")
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    starts = (packets[:, 1] & 0x40) > 0
    tables: dict[int, list[bytes]] = {}

    def table(of: int, table_id: int, program: int | None = None) -> bytes:
        if of not in tables:
            shown: dict[bytes, np.ndarray] = {}
            for packet in packets[(pid == of) & starts]:
                shown.setdefault(packet[4:].tobytes(), packet)
            tables[of] = list(dict.fromkeys(_read_section(packet, table_id) for packet in shown.values()))
        own = [x for x in tables[of] if program is None or int.from_bytes(x[3:5], "big") == program]
        if len(own) != 1:
            raise StreamError(f"{len(own)} tables on pid {of}")
        return own[0]

    def carried(of: int) -> tuple[np.ndarray, int]:
        return _carried(packets, np.flatnonzero((pid == of) & ((packets[:, 3] & 0x10) > 0)))

    pat = table(PAT_PID, 0x00)
    found = []
    for entry in range(8, len(pat) - 4, 4):
        program, pmt_pid = int.from_bytes(pat[entry : entry + 2], "big"), int.from_bytes(pat[entry + 2 : entry + 4], "big") & 0x1FFF
        if not program:  # the network table
            continue
        pmt = table(pmt_pid, 0x02, program)
        at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
        while at < len(pmt) - 4:
            data_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
            own, damaged = carried(data_pid)
            payload, stamps, access, units = _elementary(packets[own])
            damaged += carried(PAT_PID)[1] + carried(pmt_pid)[1]
            found.append(Stream(program, data_pid, int(pmt[at]), len(packets), payload, stamps, access, own[units] * PACKET, damaged))
            at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
    if not found:
        raise StreamError("no elementary stream")
    return found


def _carried(packets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """The places ``at`` of packets of one pid with payload, without those sent twice, and the errors of their counters."""
    own = packets[at]
    counters = own[:, 3].astype(np.int64) & 0x0F
    adapted = (own[:, 3] & 0x20) > 0
    flagged = adapted & (own[:, 4] > 0) & ((own[:, 5] & 0x80) > 0)
    again = np.zeros(len(own), bool)
    same = np.flatnonzero(counters[1:] == counters[:-1]) + 1
    # A repetition may have another clock reference, but the same payload.
    begin = np.where(adapted[same], 5 + own[same, 4].astype(np.int64), 4)
    equal = (own[same] == own[same - 1]) | (np.arange(PACKET) < begin[:, None])
    again[same] = equal.all(axis=1) & (own[same, 3] == own[same - 1, 3])
    jumps = (np.diff(counters) % 16 != 1) & ~again[1:] & ~flagged[1:]
    return at[~again], int(jumps.sum())


def _elementary(own: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Payload, timestamps, random-access points and first packets of the elementary packets of one stream."""
    if (own[:, 3] & 0xC0).any():
        raise StreamError("a scrambled stream")
    adapted = (own[:, 3] & 0x20) > 0
    begin = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    stream = own[np.arange(PACKET) >= begin[:, None]]
    held = PACKET - begin
    unit = np.flatnonzero((own[:, 1] & 0x40) > 0)
    offsets = (np.cumsum(held) - held)[unit]
    if not len(unit) or unit[0]:
        raise StreamError("the stream doesn't begin with an elementary packet")
    lengths = np.diff(np.append(offsets, len(stream)))
    if (lengths < 9).any():
        raise StreamError("an elementary packet without header")
    head = stream[offsets[:, None] + np.arange(9)].astype(np.int64)
    video = head[:, 3] >> 4 == 0xE
    if (head[:, :3] != (0, 0, 1)).any() or (head[:, 6] >> 6 != 2).any():
        raise StreamError("an elementary packet without start code or header")
    stated = head[:, 4] << 8 | head[:, 5]
    if ((stated + 6 != lengths) & ~(video & (stated == 0))).any() or (9 + head[:, 8] > lengths).any():
        raise StreamError("an elementary packet of another length than stated")
    stamped = head[:, 7] >> 7 > 0
    if (head[stamped, 8] < 5).any():
        raise StreamError("an elementary packet without its timestamp")
    p = stream[offsets[stamped][:, None] + np.arange(9, 14)].astype(np.int64)
    stamps = np.full(len(unit), -1, np.int64)
    stamps[stamped] = (p[:, 0] >> 1 & 7) << 30 | p[:, 1] << 22 | (p[:, 2] >> 1) << 15 | p[:, 3] << 7 | p[:, 4] >> 1
    flagged = own[unit]
    access = adapted[unit] & (flagged[:, 4] > 0) & ((flagged[:, 5] & 0x40) > 0)
    # A byte is payload if it stands at or behind the end of its unit's header.
    skip = np.zeros(len(stream) + 1, np.int64)
    np.add.at(skip, offsets, 1)
    np.add.at(skip, offsets + 9 + head[:, 8], -1)
    return stream[np.cumsum(skip[:-1]) == 0].tobytes(), stamps, access, unit


def store_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each whole text as UTF-8, padded with zero bytes to a positive multiple of 64, in a transport stream.

    NULL counts as empty; an empty text is 64 zero bytes. Equal texts have equal streams; repeated rows are stored each;
    an empty table gives an empty result. Other columns are not read. Returns doc_id, n_bytes, media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, media, held = 0, [], 0
            data = batch.column(1)
            for i in range(batch.num_rows):
                media.append(mux(pad(data[i].as_buffer().to_pybytes())))
                held += len(media[-1])
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), batch.column(2).slice(at, i + 1 - at), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    at, media, held = i + 1, [], 0

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.cast("binary").alias("data"), F.octet_length(body).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """What the streams hold, a row for each elementary stream. Adds payload, units (pts, random_access and byte position of each
    elementary packet), program, pid, stream_type, packets and continuity_errors to doc_id, n_bytes and media. Damaged
    streams raise, and so do NULL and empty ones; repeated rows are read each; an empty table gives an empty result. Other
    columns are not read."""
    schema = "doc_id long, n_bytes long, media binary, payload binary, units array<struct<pts: long, random_access: boolean, position: long>>, program int, pid int, stream_type int, packets long, continuity_errors long"
    types = pa.schema([("payload", pa.binary()), ("units", pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("position", pa.int64())]))), ("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64())])

    def out(batch: pa.RecordBatch, found: list[Stream]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(s.timestamps) for s in found)]).astype(np.int32)
        units = pa.StructArray.from_arrays([pa.array(np.concatenate([s.timestamps for s in found])), pa.array(np.concatenate([s.random_access for s in found])), pa.array(np.concatenate([s.positions for s in found]))], ["pts", "random_access", "position"])
        columns = [pa.array([s.payload for s in found], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), units)]
        columns += [pa.array([getattr(s, f.name) for s in found], f.type) for f in list(types)[2:]]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], ["doc_id", "n_bytes", "media", *types.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, held = [], [], 0
            for i in range(batch.num_rows):
                data = b"" if not batch.column(2)[i].is_valid else batch.column(2)[i].as_buffer().to_pybytes()
                for stream in demux_all(data):
                    rows.append(i)
                    found.append(stream)
                    held += len(data)
                if rows and (held >= BATCH_BYTES or i + 1 == batch.num_rows):
                    # Slices copy nothing; only rows of several streams have to be repeated.
                    whole = rows == list(range(rows[0], rows[0] + len(rows)))
                    yield out(batch.slice(rows[0], len(rows)) if whole else batch.take(pa.array(rows)), found)
                    rows, found, held = [], [], 0

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(table(spark, sf_dir, "documents")))
    points = F.size(F.filter("units", lambda u: u["random_access"]))
    feature = F.format_string(
        "program=%d;pid=%d;type=%d;packets=%d;units=%d;random_access=%d;last_pts=%d;continuity_errors=%d",
        "program", "pid", "stream_type", "packets", F.size("units"), points, F.element_at("units", -1)["pts"], "continuity_errors",
    )
    # Each access unit as pts@position, random-access points with a star.
    units = F.array_join(F.transform("units", lambda u: F.concat(u["pts"], F.lit("@"), u["position"], F.when(u["random_access"], "*").otherwise(""))), ",")
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), units.alias("units"),
    )
