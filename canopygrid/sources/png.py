"""PNG for what images here are: 8-bit colour or grey, 16-bit grey depth; not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray) -> bytes:
    """An array (height, width) or (height, width, 3) of uint8 or uint16 as a PNG file."""
    h, w = image.shape[:2]
    color = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    depth = {np.dtype(np.uint8): 8, np.dtype(np.uint16): 16}[image.dtype]
    rows = image.astype(">u2" if depth == 16 else "u1").reshape(h, -1).view(np.uint8)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(height, width) for grey, (height, width, channels) else; uint8 or uint16."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    w, h, depth, color, _, _, interlaced = head
    if depth not in (8, 16) or color not in CHANNELS or interlaced:
        raise ValueError(f"a PNG of depth {depth}, colour type {color}, interlace {interlaced} is not supported")
    n = CHANNELS[color]
    step, width = n * depth // 8, w * n * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, width + 1)
    out = np.zeros((h, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    cells = out.view(">u2").astype(np.uint16) if depth == 16 else out
    return cells.reshape(h, w) if n == 1 else cells.reshape(h, w, n)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out = row.astype(np.int64).reshape(-1, step)
    up = above.astype(np.int64).reshape(-1, step)
    left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
    for i in range(len(out)):
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            pa, pb, pc = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up[i], corner))
        left = (out[i] + guess) & 255
        out[i], corner = left, up[i]
    return out.astype(np.uint8).ravel()
