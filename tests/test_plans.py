"""Shape of the physical plans that matter at scale."""

import pytest

from factorframe.operators import portfolio, technical
from factorframe.sources import io
from factorframe.sources.panel import Panel
from factorframe.streaming.storage import work_path

SF = "/root/testdata/sf0.001"


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_combine_before_the_shuffle_without_sorting(static):
    text = plan(Panel(static, SF).bars)
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text and text.count("Exchange hashpartitioning") == 1


def test_all_indicators_share_one_exchange_by_symbol(static):
    assert plan(technical.technical_panel(Panel(static, SF).bars)).count("Exchange hashpartitioning") == 2  # bars, then symbol


def test_scans_read_only_what_is_needed(static):
    text = plan(Panel(static, SF).meta.select("symbol", "market_cap"))
    assert "p_name" not in text.split("ReadSchema")[1]


def test_date_range_prunes_partitions(static):
    path = work_path(static, "bars")
    io.write_bars(Panel(static, SF).bars, path)
    text = plan(io.read_bars(static, path, "1996-01-01", "1996-12-31"))
    assert "PartitionFilters: [" in text and "year" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date" in text


def test_top_n_is_cut_before_the_shuffle(static):
    text = plan(portfolio.strongest(Panel(static, SF).signals, 5))
    assert "WindowGroupLimit" in text and "Partial" in text
