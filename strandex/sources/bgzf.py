"""Blocked gzip files: block headers, reads from any block on, and writing.

A reader that starts in the middle of a file finds the first block by its header: a place counts as a block if its
header holds the size field, the block inflates to the length and checksum that its trailer says, and another block
(or the file's end) follows. So no one has to walk all headers of a large file before its parts are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

from .files import opened

#: Uncompressed and compressed bytes of a block at most.
LARGEST = 65536
#: Bytes read at once.
READ = 4 << 20
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_MAGIC = b"\x1f\x8b\x08\x04"


class BgzfError(ValueError):
    pass


def is_gzip(path: str) -> bool:
    """By content: the first two bytes."""
    with opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


def size_in(data: bytes | memoryview, at: int, address: int, left: int) -> int:
    """Compressed size of the block that begins at a place of data, its address in the file; left: bytes of the file
    from there on."""
    if len(data) - at < 12:
        raise BgzfError(f"truncated block header at {address}")
    if bytes(data[at : at + 4]) != _MAGIC:
        raise BgzfError(f"no blocked gzip header at {address}")
    extra = struct.unpack_from("<H", data, at + 10)[0]
    i, end = at + 12, min(at + 12 + extra, len(data))
    while i + 4 <= end:
        length = struct.unpack_from("<H", data, i + 2)[0]
        if data[i : i + 2] == b"BC" and length == 2 and i + 6 <= end:
            size = struct.unpack_from("<H", data, i + 4)[0] + 1
            if size < 12 + extra + 8 or size > left:
                raise BgzfError(f"block at {address} doesn't fit its file")
            return size
        i += 4 + length
    raise BgzfError(f"block at {address} has no size field")


def inflate(data: bytes | memoryview, address: int) -> bytes:
    """A block's content, its length and checksum verified."""
    try:
        out = zlib.decompress(data, wbits=31)
    except zlib.error as e:
        raise BgzfError(f"block at {address}: {e}") from e
    if len(out) > LARGEST:
        raise BgzfError(f"block at {address} is larger than {LARGEST} bytes")
    return out


def walk(path: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, int]]:
    """address, compressed size, uncompressed size of every block that begins in the stored bytes low to high, from
    headers and trailers alone."""
    with opened(path) as f:
        f.seek(0, 2)
        end = f.tell()
        address = first_block(f, low, end)
        while address < (end if high is None else min(high, end)):
            f.seek(address)
            head = f.read(12)
            head += f.read(struct.unpack_from("<H", head, 10)[0] if len(head) == 12 else 0)
            size = size_in(head, 0, address, end - address)
            f.seek(address + size - 4)
            yield address, size, struct.unpack("<I", f.read(4))[0]
            address += size


def first_block(f: BinaryIO, low: int, size: int) -> int:
    """Address of the first block at low or later; the file's size if there is none."""
    if low <= 0:
        return 0
    f.seek(low)
    data = f.read(4 * LARGEST)
    at = data.find(_MAGIC)
    while at >= 0:
        try:
            own = size_in(data, at, low + at, size - low - at)
            inflate(data[at : at + own], low + at)
            if low + at + own == size or data[at + own : at + own + 4] == _MAGIC:
                return low + at
        except BgzfError:
            pass
        at = data.find(_MAGIC, at + 1)
    if low + len(data) < size:
        raise BgzfError(f"no block begins within {len(data)} bytes from {low}")
    return size


Chunk = tuple[bytes, np.ndarray, np.ndarray]


class PlainFile:
    """An uncompressed file; offsets are byte offsets."""

    file_format = "plain"

    def __init__(self, path: str, chunk: int = READ):
        self.file, self.chunk = opened(path), chunk
        self.file.seek(0, 2)
        self.size = self.file.tell()

    def chunks(self, low: int, high: int) -> Iterator[Chunk]:
        """Bytes from low to high: data, places in it where offsets are known, and these offsets."""
        self.file.seek(low)
        while low < high and (data := self.file.read(min(self.chunk, high - low))):
            yield data, np.zeros(1, np.int64), np.array([low], np.int64)
            low += len(data)

    def starting(self, low: int) -> int:
        return low

    def read(self, offset: int, most: int | None = None) -> Iterator[bytes]:
        """Content from an offset on, `most` bytes at most: a short record doesn't cost a whole chunk."""
        return (data for data, _, _ in self.chunks(offset, self.size if most is None else min(self.size, offset + most)))


class BgzfFile:
    """A blocked gzip file; offsets are virtual: the block's address, shifted by 16 bits, and the place in the block."""

    file_format = "bgzf"

    def __init__(self, path: str, chunk: int = READ):
        self.file, self.chunk = opened(path), chunk
        self.file.seek(0, 2)
        self.size = self.file.tell()

    def starting(self, low: int) -> int:
        return first_block(self.file, low, self.size)

    def _blocks(self, address: int, high: int, most: int) -> Iterator[tuple[int, bytes]]:
        """Blocks from an address on that begin before high, read `most` bytes at a time."""
        data, base = b"", address
        while address < min(high, self.size):
            at = address - base
            if len(data) - at < min(LARGEST + 12, self.size - address):
                self.file.seek(address)
                data, base, at = self.file.read(max(most, LARGEST + 12)), address, 0
            own = size_in(data, at, address, self.size - address)
            yield address, inflate(memoryview(data)[at : at + own], address)
            address += own

    def chunks(self, low: int, high: int) -> Iterator[Chunk]:
        """Content of the blocks that begin from low (a block's address) and before high."""
        parts, places, offsets, n = [], [], [], 0
        for address, data in self._blocks(low, high, self.chunk):
            if data:
                parts.append(data)
                places.append(n)
                offsets.append(address << 16)
                n += len(data)
            if n >= self.chunk:
                yield b"".join(parts), np.array(places, np.int64), np.array(offsets, np.int64)
                parts, places, offsets, n = [], [], [], 0
        if n:
            yield b"".join(parts), np.array(places, np.int64), np.array(offsets, np.int64)

    def read(self, offset: int, most: int | None = None) -> Iterator[bytes]:
        """Content from a virtual offset on, block by block; at least `most` bytes if there are so many."""
        within = offset & 0xFFFF
        for address, data in self._blocks(offset >> 16, self.size, 4 * LARGEST):
            if within > len(data):
                raise BgzfError(f"no place {within} in the block at {address}")
            yield data[within:]
            within = 0


def open_file(path: str, file_format: str | None = None) -> PlainFile | BgzfFile:
    """A file by its format, or by what its first bytes say."""
    blocked = is_gzip(path) if file_format is None else file_format == BgzfFile.file_format
    return BgzfFile(path) if blocked else PlainFile(path)


def block(data: bytes, level: int = 6) -> bytes:
    """One block of up to 65,280 bytes (a block that doesn't shrink must still fit its size field)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = _MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 18 + len(body) + 8 - 1)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))
