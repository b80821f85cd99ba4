"""Grey PNG images of 8 bits, read and written with zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def write_grey(img: np.ndarray) -> bytes:
    h, w = img.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = img

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def read_grey(data: bytes) -> np.ndarray:
    """Grey values of an 8-bit PNG, grey or colour (by the usual luma weights), without interlacing; ValueError for others."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("only 8-bit grey or colour PNG files without interlacing are read")
    w, h, planes = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * planes)
    out = np.zeros((h, w, planes), np.int64)
    above = np.zeros((w, planes), np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64).reshape(w, planes)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = np.cumsum(line, 0) & 255
        elif kind > 2:
            left, corner = np.zeros(planes, np.int64), np.zeros(planes, np.int64)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x], up
        out[y] = above = line
    if planes > 2:
        return ((out[..., 0] * 299 + out[..., 1] * 587 + out[..., 2] * 114 + 500) // 1000).astype(np.uint8)
    return out[..., 0].astype(np.uint8)
