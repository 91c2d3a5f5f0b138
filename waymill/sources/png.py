"""PNG images with the standard library: decoded to RGBA bytes, encoded as RGB or RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def is_png(data: bytes) -> bool:
    return data.startswith(SIGNATURE)


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scan lines without their filters. step: bytes of a pixel, 1 at least."""
    out, before = np.zeros((height, stride), np.uint8), np.zeros(stride, np.int64)
    for y in range(height):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 2:
            line = line + before
        elif kind == 1:
            for s in range(min(step, stride)):
                line[s::step] = np.cumsum(line[s::step])
        elif kind:
            own = line.tolist()
            up = before.tolist()
            for x in range(stride):
                a, b, c = (own[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
                if kind == 3:
                    own[x] = (own[x] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    own[x] = (own[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            line = np.array(own)
        before = line & 255
        out[y] = before
    return out


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """(height x width x 4 bytes, whether the file has transparency)."""
    if not is_png(data):
        raise ValueError("not a PNG image")
    head, body, palette, clear = None, b"", None, None
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
    if not head or not body:
        raise ValueError("a PNG image without content")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or colour not in SAMPLES or not width or not height:
        raise ValueError("this kind of PNG image is not supported")
    n = SAMPLES[colour]
    stride = (width * n * depth + 7) // 8
    lines = _unfiltered(zlib.decompress(body), height, stride, max(1, n * depth // 8))
    if depth == 16:
        values = lines.reshape(height, width, n, 2)[..., 0]
    elif depth == 8:
        values = lines.reshape(height, width, n)
    else:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(height, width, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[..., None]
        if colour == 0:
            values = (values.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    out = np.full((height, width, 4), 255, np.uint8)
    alpha = colour in (4, 6)
    if colour == 3:
        out[..., :3] = palette[values[..., 0]]
        if clear:
            alpha = True
            table = np.full(256, 255, np.uint8)
            table[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = table[values[..., 0]]
    elif colour in (0, 4):
        out[..., :3] = values[..., :1]
        out[..., 3] = values[..., 1] if colour == 4 else 255
    else:
        out[..., :n] = values
    return out, alpha


def encode(pixels: np.ndarray, alpha: bool) -> bytes:
    kept = pixels if alpha else pixels[..., :3]
    height, width, n = kept.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(kept).reshape(height, width * n)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
