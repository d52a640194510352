"""Named numpy arrays as one compressed binary, for messages between tasks, and sorting of pairs."""

from __future__ import annotations

import json

import numpy as np
import zstandard


def _planes(a: np.ndarray) -> bytes:
    """Byte by byte of the entries' width, so that small numbers cost little."""
    rows = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    planes = np.empty((a.itemsize, len(a)), np.uint8)
    for i in range(a.itemsize):
        planes[i] = rows[:, i]
    return zstandard.compress(planes, 1)


def _unplaned(data: bytes, dtype: str, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(data, max_output_size=max(1, n * width)), np.uint8)
    rows = np.empty((n, width), np.uint8)
    for i in range(width):
        rows[:, i] = raw[i * n : (i + 1) * n]
    return rows.view(dtype).reshape(n)


def sorted_pairs(left: np.ndarray, right: np.ndarray, at: np.ndarray, left_top: int, right_top: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the pairs in sorted order, the places they stand at); the tops are no less than the largest numbers.
    Where a pair and its place fit in 64 bits, plain numbers are sorted."""
    width, place = int(right_top).bit_length(), int(at[-1]).bit_length() if len(at) else 0
    key = left.astype(np.uint64)
    key <<= np.uint64(width)
    key |= right
    if int(left_top).bit_length() + width + place > 64:
        order = np.argsort(key, kind="stable")
        return key[order], at[order]
    key <<= np.uint64(place)
    key |= at.view(np.uint64)
    key.sort()
    sorted_at = (key & np.uint64((1 << place) - 1)).view(np.int64)
    key >>= np.uint64(place)
    return key, sorted_at


def pack_arrays(**arrays: np.ndarray) -> bytes:
    head, body = [], []
    for name, a in arrays.items():
        told = a.dtype.str
        if a.dtype.kind == "u" and len(a):  # as wide as the largest number needs
            a = a.astype(np.min_scalar_type(a.max()))
        if not len(a):
            head.append([name, told, told, 0, 0, 0])
            continue
        table = None
        if a.dtype.kind == "f":  # few distinct values: a table and places in it
            values, places = np.unique(a, return_inverse=True)
            if 4 * len(values) < len(a):
                table = _planes(values)
                head.append([name, told, a.dtype.str, len(a), len(table), len(values)])
                body += [table, _planes(places.astype(np.uint32))]
        if table is None:
            head.append([name, told, a.dtype.str, len(a), 0, 0])
            body.append(_planes(a))
    sizes = [len(b) for b in body]
    start = json.dumps([head, sizes]).encode()
    return len(start).to_bytes(4, "little") + start + b"".join(body)


def unpack_arrays(data: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    head, sizes = json.loads(data[4 : 4 + n])
    at, parts, out = 4 + n, [], {}
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    parts = iter(parts)
    for name, told, dtype, length, table, values in head:
        if not length:
            out[name] = np.zeros(0, told)
        elif table:
            known = _unplaned(next(parts), dtype, values)
            out[name] = known[_unplaned(next(parts), "<u4", length)]
        else:
            out[name] = _unplaned(next(parts), dtype, length).astype(told, copy=False)
    return out
