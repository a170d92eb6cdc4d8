"""Log framing: records in 32 KiB blocks, each fragment with crc, length and type."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame

from mvmap.operators import files

#: Fixed values of the format: block size, header (8-byte crc, 2-byte length, 1-byte type), fragment types.
BLOCK, HEADER = 32768, 11
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def frame(records: list[bytes]) -> bytes:
    out = bytearray()
    for record in records:
        at, begun = 0, False
        while not begun or at < len(record):
            room = BLOCK - len(out) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part = record[at:at + room - HEADER]
            done = at + len(part) == len(record)
            kind = (LAST if begun else FULL) if done else (MIDDLE if begun else FIRST)
            out += struct.pack("<QHB", zlib.crc32(bytes([kind]) + part), len(part), kind) + part
            at, begun = at + len(part), True
    return bytes(out)


def unframe(raw: bytes, offset: int = 0) -> tuple[list[bytes], int]:
    """(whole records that begin at or after ``offset``, fragments dropped as damaged)."""
    found, dropped = unframe_at(raw, offset)
    return [r for _, r in found], dropped


def unframe_at(raw: bytes, offset: int = 0) -> tuple[list[tuple[int, bytes]], int]:
    """unframe() with the place of each record's first fragment. Reading begins at the
    block that holds ``offset``; the end of a record that began earlier is passed over."""
    records, held, begun, dropped = [], None, 0, 0
    at = offset - offset % BLOCK
    resync = at > 0
    while at + HEADER <= len(raw):
        room = BLOCK - at % BLOCK
        if room < HEADER:
            at += room
            continue
        crc, size, kind = struct.unpack_from("<QHB", raw, at)
        part = raw[at + HEADER:at + HEADER + size]
        if kind not in (FULL, FIRST, MIDDLE, LAST) or len(part) < size or zlib.crc32(bytes([kind]) + part) != crc:
            dropped, held = dropped + 1, None
            at += room
            continue
        if kind in (FULL, FIRST):
            held, begun, resync = bytearray(), at, False
        at += HEADER + size
        if held is None:
            dropped += not resync
            continue
        held += part
        if kind in (FULL, LAST):
            if begun >= offset:
                records.append((begun, bytes(held)))
            held = None
    return records, dropped


# Logs as DataFrames: a log file holds about one write buffer of records, so files are
# framed and grouped side by side, each in order.

#: Write buffer, most bytes of a commit group, and what a small first batch may add.
WRITE_BUFFER, GROUP_CAP, SMALL_FIRST = 4 << 20, 1 << 20, 128 << 10


def log_numbers(rows: DataFrame, order: str, size: str, buffer: int = WRITE_BUFFER) -> DataFrame:
    """rows with ``log_no``: the log rolls where the bytes before a record pass a multiple of the buffer."""
    return files.running_bucket(rows, [order], size, buffer).withColumnRenamed("bucket", "log_no")


def _in_order(rows: DataFrame, order: str, size: str, fn, schema: str) -> DataFrame:
    """fn over the sizes of each log's records in order; one log is one group, of about a buffer."""

    def apply(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by(order)
        for name, values in fn(table.column(size).to_numpy()).items():
            table = table.append_column(name, pa.array(np.asarray(values), pa.int64()))
        return table

    return rows.groupBy("log_no").applyInArrow(apply, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {schema}")


def framed(rows: DataFrame, order: str, size: str) -> DataFrame:
    """rows of numbered logs with ``block``, the block of a record's first fragment, and
    ``fragments``: a header for each fragment, padding where a block's rest cannot hold one."""

    def places(sizes):
        block, fragments, at = [], [], 0
        for n in sizes.tolist():
            room = BLOCK - at % BLOCK
            start = at + room if room < HEADER else at
            over = n - (BLOCK - start % BLOCK - HEADER)
            more = -(-over // (BLOCK - HEADER)) if over > 0 else 0
            block.append(start // BLOCK)
            fragments.append(1 + more)
            at = (start // BLOCK + 1) * BLOCK + over + HEADER * more if more else start + HEADER + n
        return {"block": block, "fragments": fragments}

    return _in_order(rows, order, size, places, "block bigint, fragments bigint")


def commit_groups(rows: DataFrame, order: str, size: str) -> DataFrame:
    """rows of numbered logs with ``commit_no``: waiting batches join the first one up to
    GROUP_CAP bytes, or up to SMALL_FIRST more than the first where that is small."""

    def groups(sizes):
        out, number, held, cap = [], -1, 0, -1
        for n in sizes.tolist():
            if held + n > cap:
                number, held = number + 1, 0
                cap = n + SMALL_FIRST if n <= SMALL_FIRST else max(n, GROUP_CAP)
            held += n
            out.append(number)
        return {"commit_no": out}

    return _in_order(rows, order, size, groups, "commit_no bigint")
