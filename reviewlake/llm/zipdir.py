"""Directories of ZIP packages, also of those beyond 4 GB or 65,535 members.

A package is never unpacked: the end record leads to the central directory, that
to each member's local header, and behind the header a stored member lies as it is,
so that any range of it is a range of the package.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from .ranged import Ranged

# Marks and lengths of the ZIP records.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
EXTRA64 = 0x0001
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED, DEFLATED = 0, 8
STEP = 1 << 20


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    encrypted: bool
    packed: int  # bytes in the package
    size: int  # bytes unpacked
    header: int  # where the local header starts


def _end(f: Ranged) -> tuple[int, int, int]:
    """Number of members, size and start of the central directory."""
    tail_at = max(0, f.size - END_SIZE - FULL16)
    tail = f.read(tail_at, f.size - tail_at)
    at = tail.rfind(END)
    # the mark may also occur inside the comment, whose length must lead to the end of the file
    while at >= 0 and (len(tail) < at + END_SIZE or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP package, or cut off")
    members, size, start = struct.unpack_from("<HII", tail, at + 10)
    ends_at = tail_at + at
    if FULL16 == members or FULL32 in (size, start):
        locator = f.read(ends_at - LOCATOR64_SIZE, LOCATOR64_SIZE)
        if locator[:4] != LOCATOR64:
            raise ValueError("no locator of the 64-bit end record")
        ends_at = struct.unpack_from("<Q", locator, 8)[0]
        end = f.read(ends_at, END64_SIZE)
        if end[:4] != END64:
            raise ValueError("no 64-bit end record")
        members, size, start = struct.unpack_from("<QQQ", end, 32)
    if start + size > ends_at:
        raise ValueError("the directory does not end before its end record")
    return members, size, start


def members(f: Ranged) -> Iterator[Member]:
    """All members in the order of the central directory, which is read a piece at a time."""
    count, size, at = _end(f)
    left, have = size, b""

    def need(n: int) -> None:
        nonlocal have, left, at
        while len(have) < n:
            step = min(left, max(STEP, n - len(have)))
            if not step:
                raise ValueError("the directory is shorter than its members")
            have += f.read(at, step)
            at, left = at + step, left - step

    for _ in range(count):
        need(ENTRY_SIZE)
        if have[:4] != ENTRY:
            raise ValueError("a directory entry without its mark")
        flags, method = struct.unpack_from("<HH", have, 8)
        packed, full, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", have, 20)
        header = struct.unpack_from("<I", have, 42)[0]
        need(ENTRY_SIZE + name_n + extra_n + note_n)
        name = have[ENTRY_SIZE: ENTRY_SIZE + name_n]
        extra = have[ENTRY_SIZE + name_n: ENTRY_SIZE + name_n + extra_n]
        have = have[ENTRY_SIZE + name_n + extra_n + note_n:]
        full, packed, header = _wide(extra, full, packed, header)
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), packed, full, header)


def _wide(extra: bytes, *fields: int) -> list[int]:
    """The fields, those that are full taken in order from the 64-bit extra field."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            wide = extra[at + 4: at + 4 + n]
        at += 4 + n
    out = []
    for field in fields:
        if field == FULL32:
            if len(wide) < 8:
                raise ValueError("a 64-bit field is missing")
            field, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        out.append(field)
    return out


def data_at(f: Ranged, member: Member) -> int:
    """Where the member's bytes start; its local header has lengths of its own."""
    head = f.read(member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name}: no local header")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + name_n + extra_n


def chunks(f: Ranged, member: Member) -> Iterator[bytes]:
    """The member's content a piece at a time, stored or deflated."""
    if member.encrypted or member.method not in (STORED, DEFLATED):
        raise ValueError(f"{member.name}: encrypted or packed by method {member.method}")
    at = data_at(f, member)
    end = at + member.packed
    unpack = zlib.decompressobj(-15) if member.method == DEFLATED else None
    while at < end:
        raw = f.read(at, min(STEP, end - at))
        at += len(raw)
        while unpack and raw:
            yield unpack.decompress(raw, STEP)
            raw = unpack.unconsumed_tail
        if not unpack:
            yield raw
    if unpack:
        yield unpack.flush()


def lines(f: Ranged, member: Member) -> Iterator[bytes]:
    rest = b""
    for piece in chunks(f, member):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest
