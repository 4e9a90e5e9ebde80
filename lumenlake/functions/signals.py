"""Quality signals of a square luma grid stored as an integer array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scale of a full edge, white level
EDGE_SCALE = 80.0
WHITE = 255.0


def blur_score(grid: Column, n: int) -> Column:
    """1 for a flat grid, 0 for strong edges: mean absolute 4-neighbour difference of inner cells."""
    inner = [y * n + x for y in range(1, n - 1) for x in range(1, n - 1)]

    def edge(acc: Column, i: Column) -> Column:
        around = sum((F.get(grid, i + step) for step in (1, -n, n)), F.get(grid, i - 1))
        return acc + F.abs(4 * F.get(grid, i) - around)

    total = F.aggregate(F.array(*[F.lit(i) for i in inner]), F.lit(0.0), edge)
    score = 1.0 - F.least(F.lit(1.0), total / len(inner) / EDGE_SCALE)
    return F.when(F.size(grid) == n * n, score)


def brightness_score(grid: Column) -> Column:
    """1 for a mid-grey grid, 0 for a black or white one."""
    mean = F.aggregate(grid, F.lit(0.0), lambda acc, p: acc + p) / F.size(grid)
    return 1.0 - F.least(F.lit(1.0), F.abs(mean / WHITE - 0.5) * 2.0)


def quality_score(blur: Column) -> Column:
    return 1.0 - blur
