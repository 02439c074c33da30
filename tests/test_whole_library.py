"""Queries over the library take all of its functions."""

from kinfold import registry
from kinfold.functions import images

DATA = "/root/testdata/sf0.001"


def test_oracle_freezes_every_function(spark):
    rows = registry.QUERIES["oracle_freeze"](spark, DATA).groupBy("skill_id").count().collect()
    assert {r["skill_id"] for r in rows} == set(images.LIBRARY) and {r["count"] for r in rows} == {500}


def test_corruption_is_planned_over_the_library(spark):
    rows = registry.QUERIES["corruption_grid"](spark, DATA).where("rho = 1.0").select("site_id").distinct().collect()
    assert {r["site_id"] for r in rows} == set(images.LIBRARY)
