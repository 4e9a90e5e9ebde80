"""The isotonic curve where points share an x."""

import itertools

import numpy as np
import pytest

from lumenlake.llm import quality


def test_points_of_one_x_share_a_value():
    for points in itertools.permutations([(0, 0), (0, 0), (0, 1), (2, 1)]):
        knots, values = quality.pool_adjacent(*np.array(points, float).T)
        assert knots.tolist() == [0, 2]
        assert values.tolist() == pytest.approx([1 / 3, 1])
