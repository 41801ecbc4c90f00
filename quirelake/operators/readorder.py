"""Reading order of detected text lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .grouped import over_groups


def band_order(points: list[tuple[float, float]], band: float = 10) -> list[int]:
    """Order of quads by their first corners: by height, then along; then each
    one moves ahead of those less than a band above that start further right."""
    order = sorted(range(len(points)), key=lambda i: (points[i][1], points[i][0]))
    for i in range(len(order) - 1):
        for j in range(i, -1, -1):
            above, below = points[order[j]], points[order[j + 1]]
            if abs(below[1] - above[1]) < band and below[0] < above[0]:
                order[j], order[j + 1] = order[j + 1], order[j]
            else:
                break
    return order


def sort_bands(det: DataFrame, band: float = 10, page: str = "page_id", x: str = "x1", y: str = "y1", det_id: str = "det_id") -> DataFrame:
    """Adds ``line_rank``, the place of each quad on its page.

    The swaps depend on those before, so no sort key gives them; a page is one
    group of at most a few thousand lines.
    """

    def rank(c: dict[str, np.ndarray]) -> tuple:
        place = np.empty(len(c[x]), np.int64)
        place[band_order(list(zip(c[x].tolist(), c[y].tolist(), strict=True)), band)] = np.arange(len(place))
        return np.arange(len(place)), (place,)

    return over_groups(det, page, [det_id], [x, y], rank, det.columns, [T.StructField("line_rank", T.LongType())])
