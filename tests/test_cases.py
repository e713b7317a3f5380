"""Small pages for what the pages table does not hold: each case with what the rules must give."""

from __future__ import annotations

import page_cases
import pytest


@pytest.mark.parametrize("name", list(page_cases.QUERIES))
def test_case(spark, duck, rows, name):
    assert rows(page_cases.QUERIES[name](spark, "").toPandas()) == rows(duck.execute(page_cases.ORACLES[name]).df())
