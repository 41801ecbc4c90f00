"""Image files as arrays without an image library: PNG and PNM in, PNG out."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG colour types.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Scan lines with their PNG filters undone."""
    lines = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            now = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = line + above
        else:
            now = line.copy()
            for i in range(stride):
                left = int(now[i - step]) if i >= step else 0
                up = int(above[i])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[i - step]) if i >= step else 0
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                now[i] = (int(now[i]) + guess) & 255
        out[y] = above = now
    return out


def _png(content: bytes) -> np.ndarray:
    at, data, palette, head = len(_PNG), [], None, None
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    w, h, depth, color, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    n = _CHANNELS[color]
    image = _unfilter(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), h, w * n, n).reshape(h, w, n)
    if color == 3:
        return palette[image[..., 0]]
    return np.repeat(image[..., :1], 3, axis=2) if n <= 2 else image[..., :3]


def _pnm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        fields.append(int(content[at:end]))
        at = end
    w, h, _ = fields
    n = 3 if content[:2] == b"P6" else 1
    image = np.frombuffer(content, np.uint8, w * h * n, at + 1).reshape(h, w, n)
    return image if n == 3 else np.repeat(image, 3, axis=2)


def decode_image(content: bytes) -> np.ndarray:
    """RGB array of an 8-bit PNG or binary PNM file; other kinds are an error."""
    if content.startswith(_PNG):
        return _png(content)
    if content[:2] in (b"P5", b"P6"):
        return _pnm(content)
    raise ValueError("not a PNG or PNM file; read it by the image source")


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG file of a grey or RGB array."""
    rows = image if image.ndim == 3 else image[..., None]
    h, w, n = rows.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows.reshape(h, w * n)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)
    return _PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def draw_boxes(image: np.ndarray, boxes, color=(255, 0, 0)) -> np.ndarray:
    """A copy with the outlines of boxes (left, top, right, bottom)."""
    out = image.copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2 in boxes:
        x1, x2 = (int(min(max(v, 0), w - 1)) for v in (x1, x2))
        y1, y2 = (int(min(max(v, 0), h - 1)) for v in (y1, y2))
        out[[y1, y2], x1 : x2 + 1] = color
        out[y1 : y2 + 1, [x1, x2]] = color
    return out
