"""MPEG transport streams as a media column: texts stored as private-data elementary streams, and streams read back.

The writer makes a program association table, a program map table and one elementary stream on PID 0x100: PES packets
of PES_BYTES with a presentation time stamp each; a PES packet begins with a random-access point and a program clock.
The reader trusts nothing of that layout: it parses the tables for the stream's PID, checks continuity counters,
reassembles PES packets from their starts, and reports time stamps with the random-access points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_text, slices, written

PACKET = 188
SYNC = 0x47
PMT_PID, DATA_PID = 0x20, 0x100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data
PES_BYTES = 32_768
PTS_STEP = 3_600  # 1/25 s at 90 kHz
ALIGN = 64
BATCH_BYTES = 8_000_000


def crc32_table() -> list[int]:
    """The CRC of MPEG sections: polynomial 0x04C11DB7, most significant bit first."""
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1
        out.append(r & 0xFFFFFFFF)
    return out


CRC = crc32_table()


def section_crc(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = (r << 8 & 0xFFFFFFFF) ^ CRC[(r >> 24) ^ b]
    return r


def section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + data).ljust(PACKET, b"\xff")


TABLES = table_packet(0, section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID,
    section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def clock(pts: int) -> bytes:
    """The 33 bits of a time stamp, in the five bytes of a PES header."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def pes_packets(payload: bytes, pts: int, counter: int) -> tuple[bytes, int]:
    """One PES packet as transport packets, and the next continuity counter. The first carries a random-access flag
    and the program clock; the last one's gap is filled inside its adaptation field."""
    length = len(payload) + 8
    pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + length.to_bytes(2, "big") + b"\x84\x80\x05" + clock(pts) + payload
    first = min(len(pes), 176)
    rest = len(pes) - first
    full, tail = divmod(rest, 184)
    count = 1 + full + (tail > 0)
    out = np.full((count, PACKET), 0xFF, np.uint8)
    data = np.frombuffer(pes, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = DATA_PID >> 8
    out[:, 2] = DATA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(count)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4] = 183 - first
    out[0, 5] = 0x50
    out[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    out[0, PACKET - first :] = data[:first]
    if full:
        out[1 : 1 + full, 4:] = data[first : first + 184 * full].reshape(full, 184)
    if tail:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - tail
        if tail < 183:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = data[-tail:]
    return out.tobytes(), (counter + count) & 15


def write_stream(payload: bytes) -> bytes:
    out, counter = [TABLES], 0
    for k, a in enumerate(range(0, max(1, len(payload)), PES_BYTES)):
        part, counter = pes_packets(payload[a : a + PES_BYTES], k * PTS_STEP, counter)
        out.append(part)
    return b"".join(out)


def read_section(data: bytes) -> bytes:
    """The body of the section in a table packet's payload; raises where its CRC is wrong."""
    start = 1 + data[0]
    size = 3 + (int.from_bytes(data[start + 1 : start + 3], "big") & 0xFFF)
    whole = data[start : start + size]
    if section_crc(whole):
        raise ValueError("section CRC mismatch")
    return whole[8:-4]


def read_stream(media: bytes) -> dict:
    """payload, pts (of each PES packet), random_access (packet numbers), continuity_errors, packets, pid, program.

    Raises ValueError on lost synchronisation, a missing table or stream, or a PES packet shorter than it says.
    """
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    m = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (m[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (m[:, 1].astype(np.int32) & 0x1F) << 8 | m[:, 2]

    def first_section(of: int) -> bytes:
        at = np.nonzero((pid == of) & (m[:, 1] & 0x40 > 0))[0]
        if not at.size:
            raise ValueError(f"no table on PID {of}")
        p = m[at[0]]
        return read_section(p[5 + p[4] if p[3] & 0x20 else 4 :].tobytes())

    programs = first_section(0)
    entries = [(int.from_bytes(programs[i : i + 2], "big"), int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(programs), 4)]
    program, pmt_pid = next(e for e in entries if e[0])
    pmt = first_section(pmt_pid)
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    stream_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    own = m[pid == stream_pid]
    if not len(own):
        raise ValueError("no packets of the stream")
    has_field, has_data = own[:, 3] & 0x20 > 0, own[:, 3] & 0x10 > 0
    skip = np.where(has_field, 5 + own[:, 4].astype(np.int64), 4)
    skip = np.where(has_data, skip, PACKET)
    counter = own[has_data, 3].astype(np.int64) & 15
    errors = int(((counter[1:] - counter[:-1]) % 16 != 1).sum())
    random_access = np.nonzero(has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0))[0]
    kept = own[np.arange(PACKET) >= skip[:, None]].tobytes()
    starts = np.nonzero(own[:, 1] & 0x40)[0]
    ends = np.cumsum(PACKET - skip)
    begin = [int(ends[s - 1]) if s else 0 for s in starts]
    payload, pts = [], []
    for a, b in zip(begin, [*begin[1:], len(kept)], strict=True):
        pes = kept[a:b]
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("no PES start code")
        size = 6 + int.from_bytes(pes[4:6], "big")
        if len(pes) < size:
            raise ValueError("short PES packet")
        if pes[7] & 0x80:
            c = pes[9:14]
            pts.append((c[0] >> 1 & 7) << 30 | c[1] << 22 | c[2] >> 1 << 15 | c[3] << 7 | c[4] >> 1)
        payload.append(pes[9 + pes[8] : size])
    return {"payload": b"".join(payload), "pts": pts, "random_access": random_access.tolist(), "continuity_errors": errors, "packets": len(m), "pid": stream_pid, "program": program}


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the stream of every whole text's UTF-8 bytes, with bytes 0 up to a positive multiple
    of 64. Null texts are empty ones (64 bytes 0); repeated rows stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = [len(x) for x in texts.to_pylist()]
            for a, b in slices(sizes, BATCH_BYTES):
                raw = texts.slice(a, b - a).to_pylist()
                media = [write_stream(x.ljust(max(ALIGN, -(-len(x) // ALIGN) * ALIGN), b"\0")) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What a stream gives, with Arrow and Spark types.
READ = {
    "payload": (pa.binary(), "binary"), "pts": (pa.list_(pa.int64()), "array<long>"), "random_access": (pa.list_(pa.int64()), "array<long>"),
    "continuity_errors": (pa.int64(), "long"), "packets": (pa.int64(), "long"),
}


def from_media(media: DataFrame) -> DataFrame:
    """media's other columns with payload, pts, random_access, continuity_errors, packets, error. Where media has a
    column of such a name, the found one gets two underscores before its name.

    A null or broken stream gives null fields and error with the reason, not an exception. Repeated rows stay; an empty
    table gives no rows."""
    names = [c for c in media.columns if c != "media"]
    rows = media.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in slices([0 if x is None else len(x) for x in column.to_pylist()], BATCH_BYTES):
                rows, why = [], []
                for x in column.slice(a, b - a).to_pylist():
                    try:
                        if x is None:
                            raise ValueError("no stream")
                        rows.append(read_stream(x))
                        why.append(None)
                    except (ValueError, IndexError, StopIteration) as e:
                        rows.append({})
                        why.append(str(e) or "malformed stream")
                made = [pa.array([r.get(k) for r in rows], t) for k, (t, _) in READ.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made, pa.array(why, pa.string())], names=["row", *READ, "error"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, {', '.join(f'{k} {t}' for k, (_, t) in READ.items())}, error string"
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col("row")[c].alias(c) for c in names), *(F.col(c).alias(f"__{c}" if c in names else c) for c in [*READ, "error"]))


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of what is read back from the stored media column, with a feature string of the stream's timing."""
    stored = written(to_media(docs), "media", compression="zstd")
    read = from_media(stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"))
    tail = F.crc32(F.substring("payload", -ALIGN, ALIGN))
    feature = F.format_string(
        "pes=%d;pts=%d..%d;rap=%d;cc_errors=%d;packets=%d",
        F.size("pts"), F.element_at("pts", 1), F.element_at("pts", -1), F.size("random_access"), F.col("continuity_errors"), F.col("packets"),
    )
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
