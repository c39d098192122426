"""Unpacked content of one compressed file, piece by piece."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

#: Bytes that are unpacked from at once.
STEP = 1 << 16


def pieces(kind: str, data) -> Iterator[bytes]:
    """Pieces of what a gz, bz2, xz or zstd buffer holds; several packed streams may follow each other."""
    view = memoryview(data)
    if kind == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(view, read_across_frames=True) as reader:
            yield from iter(lambda: reader.read(STEP), b"")
        return
    make = {"gz": lambda: zlib.decompressobj(31), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]
    at, left, unpacker = 0, b"", make()
    while at < len(view) or left:
        if unpacker.eof:
            unpacker = make()
        chunk = left or bytes(view[at : at + STEP])
        at += 0 if left else len(chunk)
        yield unpacker.decompress(chunk)
        left = unpacker.unused_data
