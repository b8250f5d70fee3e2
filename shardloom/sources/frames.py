"""The index at the end of a .zst file of many frames, in a frame that decompressors skip.

    magic 0x184D2A5D | size | n x (start of frame, its bytes, its lines) | n | b"SLFRAMES"

All numbers are little-endian; n and the mark stand last, so a reader finds the index from the file's end.
"""

from __future__ import annotations

import struct

_SKIPPED = 0x184D2A5D  # fixed value: one of the magic numbers of skippable frames
_MARK = b"SLFRAMES"
_ENTRY, _TAIL = "<QQQ", "<Q8s"  # names, not compiled structs, so that the module can be sent to workers


def index_frame(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack(_ENTRY, *entry) for entry in entries) + struct.pack(_TAIL, len(entries), _MARK)
    return struct.pack("<II", _SKIPPED, len(body)) + body


def read_index(source, size: int) -> list[tuple[int, int, int]] | None:
    """Entries of an open, seekable file of known size; None if it has no index."""
    tail, entry = struct.calcsize(_TAIL), struct.calcsize(_ENTRY)
    if size < 8 + tail:
        return None
    source.seek(size - tail)
    n, mark = struct.unpack(_TAIL, source.read(tail))
    if mark != _MARK:
        return None
    source.seek(size - tail - n * entry)
    return list(struct.iter_unpack(_ENTRY, source.read(n * entry)))
