import pytest

from loglark import params


def test_top_k():
    assert [params.top_k(k) for k in (None, 0, 1, 10_000, 10_001)] == [10, 10, 1, 10_000, 10_001]
    for bad in (-1, "3", 2.0, True):
        with pytest.raises(ValueError):
            params.top_k(bad)


def test_report_limits():
    assert [params.report_k(k) for k in (None, 0, 5, 9_999)] == [10, 1, 5, 9_999]
    assert [params.report_seconds(n) for n in (None, 0, 5, 99_999)] == [60, 1, 5, 99_999]
    with pytest.raises(ValueError):
        params.report_k("x")


def test_rates_retention_capacity():
    assert [params.rate_seconds(n) for n in (None, 0, 7)] == [60, 0, 7]
    assert [params.retention(n) for n in (None, 0, 100_000)] == [300, 300, 100_000]
    assert [params.retention(n, 3_600) for n in (None, 0, 4_000)] == [3_600, 3_600, 4_000]
    with pytest.raises(ValueError):
        params.retention(300, 3_600)
    assert [params.capacity(n) for n in (None, 0, 5)] == [1_024, 1, 5]
    assert [params.clamp(v, 1, 3) for v in (0, 2, 9)] == [1, 2, 3]


def test_cms_params():
    assert params.CmsParams() == params.CmsParams(1 << 14, 4, 0)
    assert params.CmsParams(10, 3).cells == 30
    for bad in ((0, 4), (4, 0), (-1, 1)):
        with pytest.raises(ValueError):
            params.CmsParams(*bad)
