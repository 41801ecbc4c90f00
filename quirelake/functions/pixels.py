"""Pixel kernels over (height, width, channels) arrays; they run inside Arrow-batched functions.

Catalyst can't see into them, so filter and project before a stage that calls
one. Sizes are (width, height) where a pair is asked for.
"""

from __future__ import annotations

import numpy as np


def from_row(row) -> np.ndarray:
    """RGB image of a row of Spark's image source, which holds blue, green, red bytes."""
    image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return image[..., ::-1].copy() if row["nChannels"] == 3 else np.repeat(image[..., :1], 3, axis=2) if row["nChannels"] == 1 else image[..., 2::-1].copy()


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image, rounded."""
    return np.floor(image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def _weights(source: int, target: int, support: float, kernel, antialias: bool) -> np.ndarray:
    """Rows of weights of the source pixels in each target pixel."""
    ratio = source / target
    stretch = max(ratio, 1.0) if antialias else 1.0
    centre = (np.arange(target) + 0.5) * ratio - 0.5
    gap = (np.arange(source)[None] - centre[:, None]) / stretch
    w = np.where(np.abs(gap) < support, kernel(np.abs(gap)), 0.0)
    if not antialias:  # pixels beyond the edge are those at it
        w = np.zeros((target, source))
        reach = int(np.ceil(support))
        for k in range(-reach + 1, reach + 1):
            at = np.floor(centre).astype(int) + k
            np.add.at(w, (np.arange(target), np.clip(at, 0, source - 1)), kernel(np.abs(centre - at)))
    return w / w.sum(axis=1, keepdims=True)


def _linear(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - x, 0)


def _cubic(x: np.ndarray, a: float) -> np.ndarray:
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _areas(source: int, target: int) -> np.ndarray:
    """Shares of the source pixels that each target pixel covers."""
    edge = np.arange(target + 1) * (source / target)
    pixel = np.arange(source)
    w = np.clip(np.minimum(edge[1:, None], pixel + 1) - np.maximum(edge[:-1, None], pixel), 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, size: tuple[int, int], kind: str = "linear", antialias: bool = False) -> np.ndarray:
    """Separable resampling: linear, cubic, or area (means of what a pixel covers);
    with ``antialias`` a kernel widens as the image shrinks."""
    # The sharper cubic is that of fixed kernels, the other that of widened ones.
    kernels = {"linear": (_linear, 1.0), "cubic": (lambda x: _cubic(x, -0.5 if antialias else -0.75), 2.0)}
    weights = _areas if kind == "area" else lambda source, target: _weights(source, target, kernels[kind][1], kernels[kind][0], antialias)
    w, h = size
    x = image.astype(float) if image.ndim == 3 else image[..., None].astype(float)
    x = (weights(x.shape[0], h) @ x.reshape(x.shape[0], -1)).reshape(h, *x.shape[1:])
    x = weights(x.shape[1], w) @ x  # row by row
    x = x if image.ndim == 3 else x[..., 0]
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else x.astype(image.dtype)


def resize_by_short(image: np.ndarray, side: int, kind: str = "linear") -> np.ndarray:
    """Short side to ``side``, in proportion."""
    h, w = image.shape[:2]
    ratio = side / min(h, w)
    return resize(image, (int(np.floor(w * ratio + 0.5)), int(np.floor(h * ratio + 0.5))), kind)


def crop(image: np.ndarray, size: tuple[int, int], mode: str = "C") -> np.ndarray:
    """A centre ("C") or top-left ("TL") cut; an image smaller than it is an error."""
    w, h = size
    if image.shape[0] < h or image.shape[1] < w:
        raise ValueError(f"an image of {image.shape[1]} x {image.shape[0]} has no cut of {w} x {h}")
    x, y = (0, 0) if mode == "TL" else ((image.shape[1] - w) // 2, (image.shape[0] - h) // 2)
    return image[y : y + h, x : x + w]


def crop_box(image: np.ndarray, box) -> np.ndarray:
    """Rounded half up and clamped; the whole image where nothing is left."""
    h, w = image.shape[:2]
    x1, y1, x2, y2 = (int(min(max(np.floor(v + 0.5), 0), most)) for v, most in zip(box, (w, h, w, h), strict=True))
    return image[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else image


def normalize(image: np.ndarray, mean=0.5, std=0.5, scale: float = 1 / 255) -> np.ndarray:
    return ((image.astype(np.float32) * np.float32(scale) - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).astype(np.float32)


def to_chw(image: np.ndarray) -> np.ndarray:
    """(channels, height, width), contiguous."""
    return np.ascontiguousarray((image if image.ndim == 3 else image[..., None]).transpose(2, 0, 1))


def pack(images: list[np.ndarray]) -> np.ndarray:
    """A batch tensor of images of one size."""
    return np.stack([to_chw(x) for x in images]).astype(np.float32)


def pad_right(chw: np.ndarray, width: int) -> np.ndarray:
    """Zeros at the right up to ``width``."""
    return np.pad(chw, ((0, 0), (0, 0), (0, width - chw.shape[2])))


def line_input(image: np.ndarray, height: int = 48, base: int = 320, most: int = 3200, width: int | None = None) -> np.ndarray:
    """A text line for a recogniser: scaled to ``height``, to [-1, 1], zeros at the right."""
    h, w = image.shape[:2]
    full = width or min(int(height * max(base / height, w / h)), most)
    own = min(full, int(np.ceil(height * w / h)))
    scaled = image if (h, w) == (height, own) else resize(image, (max(own, 1), height))
    return pad_right(to_chw(normalize(scaled)), full)


def pad_to(image: np.ndarray, size: tuple[int, int], fill: int = 255) -> np.ndarray:
    """Filled at the right and bottom."""
    w, h = size
    out = np.full((h, w, *image.shape[2:]), fill, image.dtype)
    out[: image.shape[0], : image.shape[1]] = image
    return out


def expand(image: np.ndarray, margin: int, fill: int = 255) -> np.ndarray:
    """A border of ``margin`` pixels on all sides."""
    return np.pad(image, ((margin, margin), (margin, margin), *((0, 0),) * (image.ndim - 2)), constant_values=fill)


def corner_color(image: np.ndarray) -> np.ndarray:
    """The commonest of the four corners; of equals the first met."""
    corners = [tuple(np.atleast_1d(image[y, x]).tolist()) for y, x in ((0, 0), (0, -1), (-1, 0), (-1, -1))]
    return np.array(max(corners, key=corners.count))


def _bounds(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """Left, top, right, bottom of what is set; None if nothing is."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else None


def trim_border(image: np.ndarray, threshold: int = 15) -> np.ndarray:
    """Without the border of the corners' commonest colour."""
    gap = np.abs(image.astype(int) - corner_color(image)).reshape(*image.shape[:2], -1).max(axis=2)
    found = _bounds(gap > threshold)
    return image if found is None else image[found[1] : found[3], found[0] : found[2]]


def trim_margin(image: np.ndarray, dark: int = 200) -> np.ndarray:
    """Bounds of what is dark after the grey values are stretched to 0..255; a flat image stays."""
    gray = to_gray(image).astype(float)
    low, high = gray.min(), gray.max()
    if low == high:
        return image
    found = _bounds((gray - low) / (high - low) * 255 < dark)
    return image if found is None else image[found[1] : found[3], found[0] : found[2]]


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Quarter turns against the clock."""
    if degrees % 90:
        raise ValueError("only quarter turns")
    return np.ascontiguousarray(np.rot90(image, degrees // 90 % 4))


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """3 x 3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def crop_quad(image: np.ndarray, quad: np.ndarray, upright: float = 1.5) -> np.ndarray:
    """A quad (top left, top right, bottom right, bottom left) as a rectangle,
    sampled linearly; turned by a quarter where it is ``upright`` times as high
    as wide."""
    quad = np.asarray(quad, float)
    side = lambda a, b: np.linalg.norm(quad[a] - quad[b])
    w, h = max(1, int(max(side(0, 1), side(2, 3)))), max(1, int(max(side(0, 3), side(1, 2))))
    back = homography(np.array([[0, 0], [w, 0], [w, h], [0, h]]), quad)
    xs, ys = np.meshgrid(np.arange(w), np.arange(h))
    at = np.stack([xs.ravel(), ys.ravel(), np.ones(w * h)]).T @ back.T
    x, y = at[:, 0] / at[:, 2], at[:, 1] / at[:, 2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    src = image.astype(float).reshape(*image.shape[:2], -1)
    take = lambda yy, xx: src[np.clip(yy, 0, src.shape[0] - 1), np.clip(xx, 0, src.shape[1] - 1)]
    out = take(y0, x0) * (1 - fx) * (1 - fy) + take(y0, x0 + 1) * fx * (1 - fy) + take(y0 + 1, x0) * (1 - fx) * fy + take(y0 + 1, x0 + 1) * fx * fy
    out = np.clip(np.floor(out + 0.5), 0, 255).astype(image.dtype).reshape(h, w, *image.shape[2:])
    return rotate(out, 90) if h / w >= upright else out


def mask_boxes(image: np.ndarray, boxes, fill: int = 255) -> np.ndarray:
    """The image with rectangles written over; empty ones do nothing."""
    out = image.copy()
    for x1, y1, x2, y2 in boxes:
        out[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)] = fill
    return out
