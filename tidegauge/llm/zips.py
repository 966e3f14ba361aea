"""Directory of a ZIP file read by ranges, ZIP64 included; stored members only."""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Fixed values of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # place of the local header


def members(file) -> list[Member]:
    """Entries of the central directory of a file with ``size`` and ``read(start, length)``."""
    tail_size = min(file.size, 22 + FULL16)
    tail = file.read(file.size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)  # a comment may hold the signature
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[at + 10:at + 20])
    if count == FULL16 or size == FULL32 or start == FULL32:
        place = file.size - tail_size + at - 20
        locator = file.read(place, 20) if place >= 0 else b""
        if locator[:4] == LOCATOR64:
            record = file.read(int.from_bytes(locator[8:16], "little"), 56)
            if record[:4] != END64:
                raise ValueError("bad ZIP64 end of central directory")
            count, size, start = struct.unpack("<QQQ", record[32:56])
    directory, out, at = file.read(start, size), [], 0
    for _ in range(count):
        if directory[at:at + 4] != ENTRY:
            raise ValueError("bad central directory entry")
        method, = struct.unpack("<H", directory[at + 10:at + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20:at + 34])
        header, = struct.unpack("<I", directory[at + 42:at + 46])
        name = directory[at + 46:at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        wide, i = b"", 0
        while i + 4 <= len(extra):
            kind, length = struct.unpack("<HH", extra[i:i + 4])
            if kind == 1:
                wide = extra[i + 4:i + 4 + length]
            i += 4 + length
        values = [full, packed, header]  # the ZIP64 field holds those that did not fit, in this order
        for j, v in enumerate(values):
            if v == FULL32:
                values[j], wide = int.from_bytes(wide[:8], "little"), wide[8:]
        out.append(Member(name, method, values[1], values[2]))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    local = file.read(member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack("<HH", local[26:30])
    return member.header + 30 + n_name + n_extra
