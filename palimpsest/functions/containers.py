"""What stands in the headers of video and matrix files, read from their bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np


def _atoms(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """Kind and body of each box of an MP4 box's body."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = len(data) - at
        if size < head:
            return
        yield kind, data[at + head : at + size]
        at += size


def _inner(data: memoryview, *path: bytes) -> Iterator[memoryview]:
    for kind, body in _atoms(data):
        if kind == path[0]:
            yield from [body] if len(path) == 1 else _inner(body, *path[1:])


def _first(data: memoryview, *path: bytes) -> memoryview | None:
    return next(_inner(data, *path), None)


def _mp4(data: memoryview) -> dict | None:
    for track in _inner(data, b"moov", b"trak"):
        media, head, times, kind = _first(track, b"mdia", b"mdhd"), _first(track, b"tkhd"), _first(track, b"mdia", b"minf", b"stbl", b"stts"), _first(track, b"mdia", b"hdlr")
        if None in (media, head, times, kind) or kind[8:12] != b"vide":
            continue
        scale = struct.unpack_from(">I", media, 20 if media[0] else 12)[0]
        runs = np.frombuffer(times[8 : 8 + 8 * struct.unpack_from(">I", times, 4)[0]], ">u4").reshape(-1, 2).astype(np.int64)
        frames, ticks = int(runs[:, 0].sum()), int(runs.prod(axis=1).sum())
        width, height = (x >> 16 for x in struct.unpack_from(">II", head, len(head) - 8))
        return {"fps": frames * scale / ticks if ticks else 0.0, "total_frames": frames, "width": width, "height": height}
    return None


def _avi(data: memoryview) -> dict | None:
    at = bytes(data[:4096]).find(b"avih")
    if at < 0 or at + 48 > len(data):
        return None
    micros, _, _, _, frames, _, _, _, width, height = struct.unpack_from("<10I", data, at + 8)
    return {"fps": 1e6 / micros if micros else 0.0, "total_frames": frames, "width": width, "height": height}


def video_header(data: bytes) -> dict | None:
    """fps, total_frames, width and height of an MP4, MOV or AVI file; None where no video track can be read."""
    view = memoryview(data)
    try:
        return _avi(view) if data[:4] == b"RIFF" else _mp4(view)
    except (struct.error, ValueError, IndexError):
        return None


#: Number types of MAT files of version 5, by their code.
_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _PACKED, _CELL = 14, 15, 1


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Type and body of each element; those of four bytes or fewer stand within their tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == _PACKED else -size % 8)


def _matrix(body: bytes, order: str, name: str = "") -> Iterator[tuple[str, np.ndarray]]:
    parts = list(_elements(body, order))
    if len(parts) < 3:
        return
    shape, name = np.frombuffer(parts[1][1], f"{order}i4"), parts[2][1].decode("latin-1") or name
    if parts[0][1][0 if order == "<" else 3] == _CELL:
        for kind, inner in parts[3:]:
            if kind == _MATRIX:
                yield from _matrix(inner, order, name)
    elif len(parts) > 3 and parts[3][0] in _MAT and len(shape) == 2:
        yield name, np.frombuffer(parts[3][1], order + _MAT[parts[3][0]]).astype(float).reshape(shape, order="F")


def matrices(data: bytes) -> list[tuple[str, np.ndarray]]:
    """Name and values of each real matrix of a MAT file, of cells one by one under the cell's name; none where it can't be read."""
    out: list[tuple[str, np.ndarray]] = []
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        return out
    order = "<" if data[126:128] == b"IM" else ">"
    try:
        for kind, body in _elements(data[128:], order):
            for inner, part in _elements(zlib.decompress(body), order) if kind == _PACKED else [(kind, body)]:
                if inner == _MATRIX:
                    out += _matrix(part, order)
    except (struct.error, ValueError, zlib.error, IndexError):
        pass
    return out
