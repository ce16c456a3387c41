"""The registered boards run with as many draws as their operators' defaults."""

from __future__ import annotations

import pytest
from conftest import SF
from scorewright.operators import ratings
from scorewright.plans import boards


@pytest.mark.parametrize(("name", "operator", "draws", "number"), [("elo_with_intervals", "elo_with_intervals", "resamples", 1000), ("rank_significance", "rank_significance", "permutations", 1000), ("separability", "elo_with_intervals", "resamples", 1000), ("bradley_terry_intervals", "bradley_terry_intervals", "resamples", 200)])
def test_draws(spark, monkeypatch, name, operator, draws, number):
    whole, asked = getattr(ratings, operator), []

    def noted(battles, **given):
        asked.append(given.get(draws, whole.__defaults__[0]))
        return whole(battles, **{draws: 2})

    monkeypatch.setattr(ratings, operator, noted)
    getattr(boards, name)(spark, SF).collect()
    assert asked == [number]
