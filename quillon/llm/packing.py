"""Columns of 64-bit numbers as one binary value, so that a shuffle moves few, dense rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values by byte planes; planes of zeros are left out."""
    n = len(columns[0])
    out = [np.array([n], np.uint32).tobytes()]
    for c in columns:
        planes = c.astype(_U).view(np.uint8).reshape(n, 8).T
        used = planes.any(axis=1)
        out += [np.packbits(used).tobytes(), planes[used].tobytes()]
    return b"".join(out)


def unpack(raw, count: int) -> list[np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    n, at, out = int(data[:4].view(np.uint32)[0]), 4, []
    for _ in range(count):
        used = np.unpackbits(data[at : at + 1]).astype(bool)
        planes = np.zeros((8, n), np.uint8)
        size = int(used.sum()) * n
        planes[used] = data[at + 1 : at + 1 + size].reshape(-1, n)
        out.append(np.ascontiguousarray(planes.T).view(_U).ravel())
        at += 1 + size
    return out


def pack_by(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed columns) for each value of ``part``, which is sorted."""
    if not len(part):
        return
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), pack(*(c[a:b] for c in columns))
