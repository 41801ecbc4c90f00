"""What the image encoders of text generators take: sizes, tiles, patches and grids.

Each view takes an RGB (height, width, 3) image and gives what an encoder is fed;
they run inside Arrow-batched model calls. Sizes are (width, height).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import pixels

# Means and deviations of published encoders.
CLIP_MEAN, CLIP_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
FORMULA_MEAN, FORMULA_STD = 0.7931, 0.1738
GRAY_MEAN, GRAY_STD = 0.9545467, 0.15394445


def square(image: np.ndarray, side: int, mean=0.5, std=0.5) -> np.ndarray:
    """Stretched to a square, whatever its proportion."""
    return pixels.to_chw(pixels.normalize(pixels.resize(image, (side, side), "cubic"), mean, std))


def centred(image: np.ndarray, size: tuple[int, int], fill: int = 0) -> np.ndarray:
    """A frame with the image in its middle, the odd pixel at the right and bottom."""
    w, h = size
    x, y = (w - image.shape[1]) // 2, (h - image.shape[0]) // 2
    out = np.full((h, w, *image.shape[2:]), fill, image.dtype)
    out[y : y + image.shape[0], x : x + image.shape[1]] = image
    return out


def by_short_side(image: np.ndarray, short: int, kind: str) -> np.ndarray:
    """Short side to ``short``, the other in proportion and cut to whole pixels."""
    h, w = image.shape[:2]
    return pixels.resize(image, (short, short * h // w) if w <= h else (short * w // h, short), kind)


def framed(image: np.ndarray, size: tuple[int, int], fill: int = 0) -> np.ndarray:
    """Short side to the frame's shorter one, then the whole down into the frame, in its middle."""
    out = by_short_side(image, min(size), "cubic")
    h, w = out.shape[:2]
    most_w, most_h = min(w, size[0]), min(h, size[1])
    if (most_w, most_h) != (w, h):
        if h > w:
            most_w = max(w * most_h // h, 1)
        elif w > h:
            most_h = max(h * most_w // w, 1)
        out = pixels.resize(out, (most_w, most_h), "cubic")
    return centred(out, size, fill)


def framed_view(image: np.ndarray, size: tuple[int, int], fill: int = 0) -> np.ndarray:
    return pixels.to_chw(pixels.normalize(framed(image, size, fill=fill), IMAGENET_MEAN, IMAGENET_STD))


def formula_view(image: np.ndarray, side: int) -> np.ndarray:
    """(1, side, side): the margin cut off, short side to ``side``, the whole down by
    areas into a square, in its middle, standardised, its luma alone."""
    x = by_short_side(pixels.trim_margin(image), side, "linear")
    h, w = x.shape[:2]
    if max(h, w) > side:
        down = side / max(h, w)
        x = pixels.resize(x, tuple(max(int(np.floor(v * down + 0.5)), 1) for v in (w, h)), "area")
    x = pixels.normalize(centred(x, (side, side)), FORMULA_MEAN, FORMULA_STD)
    return (x @ np.array([0.299, 0.587, 0.114], np.float32))[None].astype(np.float32)


def gray_view(image: np.ndarray, side: int = 448) -> np.ndarray:
    """(1, side, side): the border cut off, luma scaled so that its short side is
    one less than ``side`` or its long side ``side``, zeros at the right and bottom."""
    gray = pixels.to_gray(pixels.trim_border(image))
    h, w = gray.shape
    scale = (side - 1) / min(h, w)
    scale = side / max(h, w) if np.floor(max(h, w) * scale + 0.5) > side else scale
    size = tuple(max(int(np.floor(v * scale + 0.5)), 1) for v in (w, h))
    x = pixels.normalize(pixels.resize(gray, size, "cubic"), GRAY_MEAN, GRAY_STD)
    return np.pad(x, ((0, side - size[1]), (0, side - size[0])))[None]


def fit_within(width: int, height: int, most_width: int = 960, most_height: int = 1408, step: int = 64) -> tuple[int, int]:
    """As ``boxes.fit_within``, for one image."""
    ratio = width / height
    if width > most_width or height > most_height:
        width, height = (int(most_height * ratio), most_height) if ratio * most_height <= most_width else (most_width, int(most_width / ratio))
    return max(width // step * step, step), max(height // step * step, step)


def fitted_view(image: np.ndarray) -> np.ndarray:
    return pixels.to_chw(pixels.normalize(pixels.resize(image, fit_within(image.shape[1], image.shape[0]), "cubic")))


def pixel_budget(width: int, height: int, least: int, most: int, step: int = 28, frames: int = 2) -> tuple[int, int]:
    """As ``boxes.pixel_budget``, for one image."""
    if min(width, height) < step:
        grow = max(step / height, step / width)
        width, height = int(width * grow), int(height * grow)
    near = lambda v: int(np.floor(v / step + 0.5)) * step
    area, own = frames * near(width) * near(height), frames * width * height
    if area > most:
        down = np.sqrt(own / most)
        return max(int(width / down // step) * step, step), max(int(height / down // step) * step, step)
    if area < least:
        up = np.sqrt(least / own)
        return int(np.ceil(width * up / step)) * step, int(np.ceil(height * up / step)) * step
    return near(width), near(height)


def patches(chw: np.ndarray, side: int, merge: int = 2, frames: int = 2) -> np.ndarray:
    """(patches, channels * frames * side * side) of an image whose sides are
    multiples of ``merge * side``.

    Patches of a ``merge`` x ``merge`` block follow one another, blocks row by
    row; in a patch a channel's frames, all the same, stand together.
    """
    c, h, w = chw.shape
    blocks = chw.reshape(c, h // side // merge, merge, side, w // side // merge, merge, side).transpose(1, 4, 2, 5, 0, 3, 6)
    return np.repeat(blocks[..., None, :, :], frames, axis=-3).reshape(h // side * (w // side), -1)


@dataclass(frozen=True)
class Patched:
    """Patches of an image, the grid (frames, rows, columns) they come from, and
    the image tokens that merged blocks become."""

    values: np.ndarray
    grid: tuple[int, int, int]
    tokens: int


def patched(image: np.ndarray, size: tuple[int, int], side: int, mean, std, antialias: bool, merge: int = 2) -> Patched:
    chw = pixels.to_chw(pixels.normalize(pixels.resize(image, size, "cubic", antialias), mean, std))
    rows, cols = size[1] // side, size[0] // side
    return Patched(patches(chw, side, merge), (1, rows, cols), rows // merge * (cols // merge))


def budget_view(image: np.ndarray, least: int = 12544, most: int = 9633792) -> Patched:
    """Patches of 14 of an image scaled into a pixel budget."""
    return patched(image, pixel_budget(image.shape[1], image.shape[0], least, most), 14, CLIP_MEAN, CLIP_STD, antialias=True)


def grids(total: int = 288, least: int = 4, most: int = 24, merge: int = 2) -> list[tuple[int, int]]:
    """(rows, columns) of all grids of ``total`` patches whose sides are multiples
    of ``merge`` within [least, most]."""
    sides = [r for r in range(least, most + 1, merge) if total % r == 0]
    return [(r, total // r) for r in sides if least <= total // r <= most and total // r % merge == 0]


def grid_view(image: np.ndarray, total: int = 288, side: int = 16) -> Patched:
    """Patches of 16 on the grid whose proportion is nearest to the image's, the first of equals."""
    h, w = image.shape[:2]
    rows, cols = min(grids(total), key=lambda g: abs(g[1] / g[0] - w / h))
    return patched(image, (cols * side, rows * side), side, 0.5, 0.5, antialias=False)


def capped_size(width: int, height: int, longest: int = 1540, step: int = 28) -> tuple[int, int]:
    """Long side down to ``longest``, in whole pixels, then both up to multiples of ``step``."""
    ratio = max(width, height) / longest
    if ratio > 1:
        width, height = int(width / ratio), int(height / ratio)
    up = lambda v: ((v - 1) // step + 1) * step
    return up(width), up(height)


def capped_view(image: np.ndarray, longest: int = 1540, step: int = 28) -> np.ndarray:
    """An image whose sides over ``step`` are its token grid."""
    return pixels.to_chw(pixels.normalize(pixels.resize(image, capped_size(image.shape[1], image.shape[0], longest, step), "cubic"), CLIP_MEAN, CLIP_STD))


def whole_tiles(width: int, height: int, longest: int = 2048, tile: int = 512) -> tuple[tuple[int, int], tuple[int, int]]:
    """Size of an image scaled to ``longest`` (the other side even, one at least),
    and the multiples of ``tile`` it is then stretched to."""
    ratio = width / height
    even = lambda v: max(int(v) + int(v) % 2, 1)
    scaled = (longest, even(longest / ratio)) if width >= height else (even(longest * ratio), longest)
    up = lambda v: -(-int(v) // tile) * tile
    ratio = scaled[0] / scaled[1]
    if scaled[0] >= scaled[1]:
        w = up(scaled[0])
        return scaled, (w, max(up(w / ratio), tile))
    h = up(scaled[1])
    return scaled, (max(up(h * ratio), tile), h)


@dataclass(frozen=True)
class Tiled:
    """Tiles row by row and the whole image last, (n, 3, side, side), and the rows
    and columns of tiles: none where the whole is all there is."""

    values: np.ndarray
    rows: int
    cols: int


def tiled_view(image: np.ndarray, longest: int = 2048, tile: int = 512) -> Tiled:
    """Tiles of an image and the whole of it in one more."""
    scaled, stretched = whole_tiles(image.shape[1], image.shape[0], longest, tile)
    x = pixels.resize(pixels.resize(image, scaled), stretched)
    rows, cols = stretched[1] // tile, stretched[0] // tile
    parts = [x[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile] for r in range(rows) for c in range(cols)]
    if len(parts) == 1:
        return Tiled(pixels.pack([pixels.normalize(x)]), 0, 0)
    return Tiled(pixels.pack([pixels.normalize(p) for p in [*parts, pixels.resize(x, (tile, tile))]]), rows, cols)
