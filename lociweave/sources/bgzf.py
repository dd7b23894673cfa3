"""Blocked gzip: writing with virtual offsets, reading as bytes."""

from __future__ import annotations

import gzip
import struct
import zlib

_FULL = 65280
#: The empty block that ends every file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class BgzfWriter:
    """Compresses to a binary file in independent blocks; ``tell`` is the virtual offset of the next byte."""

    def __init__(self, out) -> None:
        self.out, self.held, self.done = out, bytearray(), 0

    def tell(self) -> int:
        return self.done << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= _FULL:
            self._block(bytes(self.held[:_FULL]))
            del self.held[:_FULL]

    def _block(self, data: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        block = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
        self.out.write(block)
        self.done += len(block)

    def flush(self) -> None:
        """Ends the block that is being filled, so that blocks from elsewhere may follow."""
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.out.write(EOF_BLOCK)


def decompress(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
