import pytest
from pyspark.sql import functions as F

from helpers import lines, row_set, rows
from loglark.operators import cms, misra_gries, space_saving
from loglark.operators.parse import parse_logs
from loglark.params import CmsParams
from loglark.plans import snapshot

P = CmsParams(256, 3)


def log(client: str, endpoint: str, status: int, second: int) -> str:
    return f'{client} - - [24/Sep/2025:10:00:{second:02d} +0000] "GET {endpoint} H" {status}'


OLD = [log("1.1.1.1", "/ok", 200, 0), log("2.2.2.2", "/bad", 500, 3), "broken"]
NEW = [log("1.1.1.1", "/ok", 200, 3), log("3.3.3.3", "/new", 404, 9), log("x", "/ok", 200, 9).replace("24/Sep", "77/Xyz")]


def state(spark, values, **kw):
    return snapshot.build(parse_logs(lines(spark, *values), event_clock=True), **{"cms_params": P, **kw})


def everything(s: snapshot.State) -> dict:
    return {
        "counts": row_set(s.counts),
        "buckets": row_set(s.buckets.select(F.unix_timestamp("sec"), "n")),
        "cms": row_set(s.cms.cells),
        "mg": row_set(s.mg.rows),
        "ss": row_set(s.ss.rows.select("dim", "rank", "key", "n", "err", "floor")),
        "params": (s.cms.params, s.mg.capacity, s.ss.capacity),
    }


def test_round_trip(spark, tmp_path):
    before = state(spark, OLD, mg_capacity=7, ss_capacity=9)
    snapshot.save(before, str(tmp_path / "s"))
    after = snapshot.load(spark, str(tmp_path / "s"))
    assert everything(after) == everything(before)
    assert row_set(after.counts.where("dim != 'ip' AND dim != 'endpoint'")) == {
        ("total", "", 2),
        ("error", "", 1),
        ("status", "200", 1),
        ("status", "500", 1),
    }
    assert {n for _, n in row_set(cms.row_totals(after.cms))} == {2}


def test_resume_equals_one_run(spark, tmp_path):
    snapshot.save(state(spark, OLD), str(tmp_path / "s"))
    resumed = snapshot.resume(snapshot.load(spark, str(tmp_path / "s")), state(spark, NEW))
    whole = state(spark, OLD + NEW)
    assert everything(resumed) == everything(whole)
    # A line without a readable time counts everywhere but in the buckets.
    assert sum(n for _, n in row_set(resumed.buckets)) == 4
    snapshot.save(resumed, str(tmp_path / "s"))
    assert everything(snapshot.load(spark, str(tmp_path / "s"))) == everything(whole)


def test_newest_save_wins_and_half_a_save_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshot.save(state(spark, OLD), path)
    snapshot.save(state(spark, NEW), path)
    assert everything(snapshot.load(spark, path)) == everything(state(spark, NEW))
    broken = state(spark, OLD)
    bad = broken.buckets.select("sec", F.raise_error(F.lit("disk full")).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="disk full"):
        snapshot.save(snapshot.replace(broken, buckets=bad), path)
    assert everything(snapshot.load(spark, path)) == everything(state(spark, NEW))


def test_missing(spark, tmp_path):
    with pytest.raises(snapshot.SnapshotError, match="no snapshot"):
        snapshot.load(spark, str(tmp_path / "none"))
    nothing = snapshot.load(spark, str(tmp_path / "none"), missing_ok=True)
    assert rows(nothing.counts) == []


def test_empty_state_is_neutral(spark):
    fresh = snapshot.empty(spark, P)
    assert everything(snapshot.resume(fresh, state(spark, NEW))) == everything(state(spark, NEW))


def test_resume_needs_equal_parameters(spark):
    with pytest.raises(snapshot.SnapshotError):
        snapshot.resume(state(spark, OLD, cms_params=None), state(spark, NEW))
    with pytest.raises(ValueError):
        snapshot.resume(state(spark, OLD, mg_capacity=2), state(spark, NEW))


def write_commit(spark, path, version, fmt, sections):
    row = (version, 1, fmt, sections, None, None, None, None, None)
    spark.createDataFrame([row], snapshot.COMMITS).write.parquet(f"{path}/commits")


def test_summaries_of_older_versions_are_built_from_counts(spark, tmp_path):
    path = str(tmp_path / "v1")
    full = state(spark, OLD)
    full.counts.where("dim != 'endpoint'").write.parquet(f"{path}/versions/one/counts")
    write_commit(spark, path, "one", 1, ["counts"])
    loaded = snapshot.load(spark, path)
    assert row_set(loaded.counts) == {r for r in row_set(full.counts) if r[0] != "endpoint"}
    clients = {k: n for d, k, n in row_set(full.counts) if d == "ip"}
    assert dict(rows(misra_gries.top(loaded.mg, dim="ip"))) == clients
    resumed = snapshot.resume(loaded, state(spark, NEW, cms_params=None))
    exact = resumed.counts.where("dim = 'ip'")
    found = cms.estimate(resumed.cms, exact, "key")
    assert found.count() and found.where("est < n").count() == 0 and resumed.cms.params == CmsParams()
    assert {r[0] for r in rows(space_saving.top(resumed.ss, dim="ip"))} == {r["key"] for r in exact.collect()}


def test_first_start_takes_any_parameters(spark, tmp_path):
    new = state(spark, NEW, cms_params=CmsParams(256, 2), mg_capacity=5, ss_capacity=6)
    got = snapshot.resume(snapshot.load(spark, str(tmp_path / "none"), missing_ok=True), new)
    assert (got.cms.params, got.mg.capacity, got.ss.capacity) == (CmsParams(256, 2), 5, 6)
    assert everything(got) == everything(new)


def test_unknown_version_is_an_error(spark, tmp_path):
    for fmt in (0, snapshot.FORMAT + 1):
        path = str(tmp_path / f"v{fmt}")
        write_commit(spark, path, "x", fmt, [])
        with pytest.raises(snapshot.SnapshotError, match="not known"):
            snapshot.load(spark, path)


def test_resize_window(spark):
    small = snapshot.resize_window(state(spark, OLD + NEW), 7)
    assert [n for _, n in sorted(row_set(small.buckets))] == [2, 1]
    assert everything(snapshot.resize_window(small, 1_000))["buckets"] == everything(small)["buckets"]
