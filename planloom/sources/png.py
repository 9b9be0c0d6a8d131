"""PNG images with 8 or 16 bits a sample, grey or colour, without interlace: enough for depth,
confidence and frames. Spark's image source keeps only the low byte of 16-bit samples."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(raw: bytes) -> np.ndarray:
    """(height, width) or (height, width, channels) array of uint8 or uint16."""
    if raw[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if interlace or depth not in (8, 16) or colour not in CHANNELS:
        raise ValueError("this kind of PNG isn't supported")
    step = CHANNELS[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width, step), np.uint8)
    above = np.zeros((width, step), np.uint8)
    for y in range(height):
        line = rows[y, 1:].reshape(width, step)
        out[y] = above = unfiltered(int(rows[y, 0]), line, above)
    values = out.reshape(height, width, CHANNELS[colour], depth // 8)
    values = values[..., 0] if depth == 8 else values.view(">u2")[..., 0].astype(np.uint16)
    return values[..., 0] if colour == 0 else values


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, 0, dtype=np.uint8)
    if kind == 2:
        return line + above
    out = np.zeros_like(line)
    left = np.zeros(line.shape[1], np.int64)
    corner = np.zeros(line.shape[1], np.int64)
    for x in range(len(line)):
        up = above[x].astype(np.int64)
        if kind == 3:
            guess = (left + up) // 2
        else:
            base = left + up - corner
            far = np.abs(np.stack([base - left, base - up, base - corner]))
            guess = np.choose(far.argmin(0), [left, up, corner])
        left = (line[x] + guess) & 255
        corner = up
        out[x] = left
    return out


def encode(image: np.ndarray) -> bytes:
    """A grey or RGB image of uint8 or uint16, unfiltered."""
    image = np.ascontiguousarray(image)
    colour = 0 if image.ndim == 2 else 2
    wide = image.astype(">u2") if image.dtype == np.uint16 else image.astype(np.uint8)
    lines = wide.reshape(len(image), -1).view(np.uint8)
    body = np.concatenate([np.zeros((len(image), 1), np.uint8), lines], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if image.dtype == np.uint16 else 8, colour, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
