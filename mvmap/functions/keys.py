"""Order-preserving keys, tags and separators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entry types and the largest sequence number.
PUT, DELETE, SEEK = 1, 2, 3
MAX_SEQUENCE = (1 << 56) - 1


def pack_tag(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))


def tag_sequence(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def tag_op(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(255).cast("bigint")).cast("int")


def parse_internal_key(key: Column) -> Column:
    """struct(user_key, seq, op) of user bytes followed by an 8-byte little-endian
    tag; null below 8 bytes."""
    n = F.octet_length(key) - 8
    tail = F.hex(F.substring(key, n + 1, F.lit(8)))
    swapped = F.concat(*[F.substring(tail, 15 - 2 * i, 2) for i in range(8)])
    tag = F.conv(swapped, 16, -10).cast("bigint")
    return F.when(n >= 0, F.struct(F.substring(key, F.lit(1), n).alias("user_key"), tag_sequence(tag).alias("seq"), tag_op(tag).alias("op")))


def fixed_le(value: Column, width: int) -> Column:
    """value as ``width`` little-endian bytes."""
    hexed = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(width)]))


def unfixed_le(raw: Column, width: int) -> Column:
    hexed = F.hex(raw)
    return F.conv(F.concat(*[F.substring(hexed, 2 * (width - i) - 1, 2) for i in range(width)]), 16, -10).cast("bigint")


def length_prefixed(raw: Column) -> Column:
    return F.concat(fixed_le(F.octet_length(raw), 4), raw)


def length_value(raw: Column) -> Column:
    """The bytes of a length_prefixed() value that stands first; null if cut short."""
    n = unfixed_le(F.substring(raw, F.lit(1), F.lit(4)), 4)
    return F.when((F.octet_length(raw) >= 4) & (F.octet_length(raw) >= 4 + n), F.substring(raw, F.lit(5), n.cast("int")))


def ordered_long(value: Column) -> Column:
    """8 big-endian bytes whose unsigned order is the numeric order."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0"))


def internal_order(key: str = "user_key", seq: str = "seq", op: str = "op") -> list[Column]:
    return [F.col(key).asc(), F.col(seq).desc(), F.col(op).desc()]


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0))


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short key k with start <= k < limit."""
    n = next((i for i, (x, y) in enumerate(zip(start, limit)) if x != y), min(len(start), len(limit)))
    if n < min(len(start), len(limit)) and start[n] < 255 and start[n] + 1 < limit[n]:
        return start[:n] + bytes([start[n] + 1])
    return start


def shortest_successor(key: bytes) -> bytes:
    """A short key at or after ``key``."""
    for i, c in enumerate(key):
        if c != 255:
            return key[:i] + bytes([c + 1])
    return key


def internal_separator(start: bytes, limit: bytes) -> bytes:
    """shortest_separator() of internal keys: where the user part gets shorter, it stands
    before all its versions; else ``start`` stays."""
    return _shorter(start, shortest_separator(start[:-8], limit[:-8]))


def internal_successor(key: bytes) -> bytes:
    return _shorter(key, shortest_successor(key[:-8]))


def _shorter(key: bytes, user: bytes) -> bytes:
    if len(user) < len(key) - 8 and key[:-8] < user:
        return user + (MAX_SEQUENCE << 8 | SEEK).to_bytes(8, "little")
    return key


def compare_internal(a: bytes, b: bytes) -> int:
    """User parts ascending, then tags descending."""
    if a[:-8] != b[:-8]:
        return -1 if a[:-8] < b[:-8] else 1
    x, y = (int.from_bytes(k[-8:], "little") for k in (a, b))
    return (y > x) - (y < x)


def internal_key(user_key: bytes, seq: int, op: int) -> bytes:
    return user_key + (seq << 8 | op).to_bytes(8, "little")
