"""Queries over whole tables leave no row out; their twins are in test_queries."""

from pagelake import queries as core
from pagelake.sources import fixtures as X


def test_every_region_is_merged(spark, sf_dir):
    merged = core.QUERIES["merge_adjacent"](spark, sf_dir)
    members = merged.selectExpr("page_id", "explode(members) AS region_idx")
    regions = X.regions(spark, sf_dir)
    assert members.count() == regions.count() and merged.where("size(members) > 1").count() > 0
    assert members.join(regions, ["page_id", "region_idx"], "left_anti").count() == 0


def test_gaps_of_whole_pages(spark, sf_dir):
    assert {"column_gaps", "merge_adjacent"} <= set(core.ORACLE_SQL)
    assert not any("% 4" in core.ORACLE_SQL[name] for name in ("column_gaps", "merge_adjacent"))
    assert core.QUERIES["column_gaps"](spark, sf_dir).count() > 0
