import datetime as dt
import glob
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import lines, row_set, rows
from loglark.operators import cms, counts, misra_gries, space_saving
from loglark.operators.parse import parse_logs
from loglark.params import CmsParams
from loglark.plans import snapshot
from loglark.sources import stream_logs, stream_tail
from loglark.sources import tail as tail_module
from loglark.sources.tail import TailReader, read_lines
from loglark.streaming import runs, state


def log(i: int, second: int | None = None) -> str:
    second = i % 60 if second is None else second
    return f'10.0.0.{i % 7} - - [24/Sep/2025:10:00:{second:02d} +0000] "GET /p{i % 5} H" {200 + i % 3}'


LOG = [log(i) if i % 10 else f"bad {i}" for i in range(200)]


class Folders:
    def __init__(self, base):
        self.inn, self.out, self.checkpoint = base / "in", str(base / "out"), str(base / "cp")
        self.inn.mkdir()
        self.files = 0

    def add(self, values):
        (self.inn / f"f{self.files}.log").write_text("".join(v + "\n" for v in values))
        self.files += 1


@pytest.fixture
def folders(tmp_path):
    return Folders(tmp_path)


def drain(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def parsed(spark, folders, **limits):
    return parse_logs(stream_logs(spark, str(folders.inn), **limits), event_clock=True)


def batch(spark, values):
    return parse_logs(lines(spark, *values), event_clock=True)


def test_counts_restart_and_compaction(spark, folders):
    out = folders.out
    for k, part in enumerate((LOG[:50], LOG[50:120], LOG[120:])):
        folders.add(part)
        drain(runs.run_counts(parsed(spark, folders), out, folders.checkpoint, drain=True, state_partitions=2))
        if k == 1:
            runs.compact_counts(spark, out, f"{out}-compact")
            out = f"{out}-compact"
    want = row_set(counts.all_counts(batch(spark, LOG)))
    assert row_set(runs.current_counts(spark, out)) == want
    # Nothing new: nothing changes.
    drain(runs.run_counts(parsed(spark, folders), out, folders.checkpoint, drain=True, state_partitions=2))
    assert row_set(runs.current_counts(spark, out)) == want
    top = rows(runs.current_top(spark, out, "ip", 2))
    assert top == sorted(((k, n) for d, k, n in want if d == "ip"), key=lambda r: (-r[1], r[0]))[:2]


def test_limits_make_several_batches(spark, folders):
    for i in range(4):
        folders.add(LOG[i * 50 : (i + 1) * 50])
    query = drain(runs.run_counts(parsed(spark, folders, max_files=1), folders.out, folders.checkpoint, drain=True, state_partitions=1))
    assert sum(p.numInputRows > 0 for p in query.recentProgress) == 4
    assert row_set(runs.current_counts(spark, folders.out)) == row_set(counts.all_counts(batch(spark, LOG)))


COUNT_ROW = "dim string, key string, n long"


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    table = runs.counts_table(str(tmp_path / "t"))
    table.write(spark.createDataFrame([("ip", "a", 1)], COUNT_ROW), 0)
    second = spark.createDataFrame([("ip", "a", 5), ("ip", "b", 2)], COUNT_ROW)
    for _ in range(2):
        table.write(second, 1)
    assert row_set(runs.current_counts(spark, str(tmp_path / "t"))) == {("ip", "a", 5), ("ip", "b", 2)}
    assert row_set(table.newest(spark)) == {("ip", "a", 5), ("ip", "b", 2)}
    assert row_set(table.newest(spark, before=1)) == {("ip", "a", 1)} and rows(table.newest(spark, before=0)) == []


def test_the_newest_batch_may_be_written_again_after_compaction(spark, tmp_path):
    """A restart may repeat the last batch: it must not meet its own rows in the sum."""
    old, new = str(tmp_path / "a"), str(tmp_path / "b")
    one = spark.createDataFrame([(0, "ip", "a", 1)], f"epoch int, {COUNT_ROW}")
    for i in range(4):
        runs.state_table(old).write(one, i)
    runs.compact_state(spark, old, new)
    assert {r.batch_id: r.n for r in runs.state_table(new).rows(spark).collect()} == {2: 3, 3: 1}
    runs.state_table(new).write(one, 3)
    runs.state_table(new).write(one, 4)
    assert row_set(runs.current_state(spark, new).counts) == {("ip", "a", 5)}
    runs.compact_state(spark, str(tmp_path / "none"), str(tmp_path / "c"))
    assert rows(runs.current_state(spark, str(tmp_path / "c")).counts) == []


def test_stream_on_a_folder_that_comes_later(spark, folders):
    later = folders.inn / "sub"
    source = parse_logs(stream_logs(spark, str(later), missing_ok=True), event_clock=True)
    drain(runs.run_counts(source, folders.out, folders.checkpoint, drain=True, state_partitions=1))
    assert rows(runs.current_counts(spark, folders.out)) == []
    later.mkdir()
    (later / "a.log").write_text("\n".join(LOG))
    source = parse_logs(stream_logs(spark, str(later), missing_ok=True), event_clock=True)
    drain(runs.run_counts(source, folders.out, folders.checkpoint, drain=True, state_partitions=1))
    assert row_set(runs.current_counts(spark, folders.out)) == row_set(counts.all_counts(batch(spark, LOG)))


def test_empty_table(spark, tmp_path):
    assert rows(runs.current_counts(spark, str(tmp_path / "none"))) == []
    assert rows(misra_gries.top(runs.current_mg(spark, str(tmp_path / "none")), dim="ip")) == []


def test_session_settings_are_put_back(spark, folders):
    folders.add(LOG[:5])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    drain(runs.run_counts(parsed(spark, folders), folders.out, folders.checkpoint, drain=True, state_partitions=3))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    state = os.path.join(folders.checkpoint, "state", "0")
    assert sorted(d for d in os.listdir(state) if d.isdigit()) == ["0", "1", "2"]
    assert any(f.endswith(".changelog") for f in os.listdir(os.path.join(state, "0")))


def test_late_seconds_are_dropped_between_batches(spark, folders):
    def run():
        query = runs.run_buckets(parsed(spark, folders), folders.out, folders.checkpoint, window=3, drain=True, state_partitions=1)
        drain(query)
        return query

    folders.add([log(0, 10)])
    run()
    folders.add([log(0, 5), log(0, 7), log(0, 8), log(0, 9), log(0, 10)])
    run()
    kept = runs.current_buckets(spark, folders.out).select(F.second("sec"), "n")
    assert row_set(kept) == {(8, 1), (9, 1), (10, 2)}


def test_sketches_go_on_after_a_restart(spark, folders):
    p = CmsParams(64, 2)
    for part in (LOG[:80], LOG[80:90], LOG[90:]):
        folders.add(part)
        lines_in = parsed(spark, folders)
        drain(runs.run_cms(lines_in, folders.out, folders.checkpoint + "c", p, drain=True, state_partitions=1))
        drain(runs.run_heavy_hitters(lines_in, folders.checkpoint + "h", 50, 2, drain=True, state_partitions=2))
    whole = batch(spark, LOG)
    assert row_set(runs.current_cms(spark, folders.out).cells) == row_set(cms.build(whole.where("ok"), "ip", p).cells)
    want = {(d, k, n) for d, k, n in row_set(counts.all_counts(whole)) if d in ("ip", "endpoint")}
    assert row_set(runs.current_mg(spark, folders.checkpoint + "h").rows) == want
    ss = runs.current_ss(spark, folders.checkpoint + "h")
    assert row_set(ss.rows.select("dim", "key", "n")) == want
    assert rows(space_saving.top(ss, 1, "endpoint"))[0][2:] == (0, rows(space_saving.top(ss, 1, "endpoint"))[0][1])
    with pytest.raises(ValueError, match="started with"):
        runs.run_cms(parsed(spark, folders), folders.out, folders.checkpoint + "c", CmsParams(32, 2), drain=True)


def test_state_of_heavy_hitters_is_bounded_and_keeps_its_bounds(spark, folders):
    """Many more keys than counters, in several batches: at most salts x capacity are kept, and the bounds hold for every key."""
    capacity, salts = 6, 3
    keys = [i % 5 if i % 2 else 100 + i * 7 % 211 for i in range(1200)]
    for k in range(3):
        folders.add(f'h{x} - - [24/Sep/2025:10:00:00 +0000] "GET /p{x % 3} H" 200' for x in keys[k * 400 : (k + 1) * 400])
    source = parsed(spark, folders, max_files=1)
    drain(runs.run_heavy_hitters(source, folders.checkpoint, capacity, salts, drain=True, state_partitions=3))
    kept = state.summaries(spark, folders.checkpoint).collect()
    assert all(len(r.mg_keys) <= capacity and len(r.ss_keys) <= capacity for r in kept)
    assert len([r for r in kept if r.dim == "ip"]) == salts
    exact = {f"h{x}": n for x, n in Counter(keys).items()}
    mg = {k: n for d, k, n in rows(runs.current_mg(spark, folders.checkpoint).rows) if d == "ip"}
    ss = {r.key: r for r in runs.current_ss(spark, folders.checkpoint).rows.where("dim = 'ip'").collect()}
    assert len(mg) <= capacity and len(ss) == capacity
    for key, n in exact.items():
        assert n - len(keys) / (capacity + 1) <= mg.get(key, 0) <= n
        if key in ss:
            assert n <= ss[key].n <= n + len(keys) / capacity and ss[key].n - ss[key].err <= n
        else:
            assert n <= next(iter(ss.values())).floor <= len(keys) / capacity


def test_heavy_hitters_of_another_capacity_are_an_error(spark, folders):
    folders.add(LOG[:20])
    drain(runs.run_heavy_hitters(parsed(spark, folders), folders.checkpoint, 5, 2, drain=True, state_partitions=1))
    folders.add(LOG[20:40])
    query = runs.run_heavy_hitters(parsed(spark, folders), folders.checkpoint, 6, 2, drain=True, state_partitions=1)
    with pytest.raises(Exception, match="capacity of 5"):
        query.awaitTermination()


def test_old_seconds_leave_the_state(spark, folders):
    for k, part in enumerate(([log(1), log(2), log(2)], [log(2), log(9)], [log(30), log(28)])):
        folders.add(part)
        drain(runs.run_seconds(parsed(spark, folders), folders.checkpoint, window=20, drain=True, state_partitions=1))
        got = row_set(state.kept_seconds(spark, folders.checkpoint).select(F.second("sec"), "n"))
        assert ((2, 2 if k == 0 else 3) in got) == (k < 2 or 2 % state.SALTS not in (28 % state.SALTS, 30 % state.SALTS))
        last = runs.current_seconds(spark, folders.checkpoint, 20).select(F.second("sec"), "n")
        assert row_set(last) == [{(1, 1), (2, 2)}, {(1, 1), (2, 3), (9, 1)}, {(28, 1), (30, 1)}][k]
    drain(runs.run_seconds(parsed(spark, folders), folders.checkpoint + "-one", window=3, drain=True, state_partitions=1))
    kept = state.kept_seconds(spark, folders.checkpoint + "-one").count()
    assert kept <= 3 * state.SALTS
    assert rows(runs.current_seconds(spark, folders.checkpoint + "-none")) == []


def test_whole_state_in_one_pass(spark, folders):
    p, sizes = CmsParams(64, 2), {"mg_capacity": 50, "ss_capacity": 40}
    for i in range(5):
        folders.add(LOG[i * 40 : (i + 1) * 40])
    drain(runs.run_state(parsed(spark, folders, max_files=2), folders.out, folders.checkpoint, drain=True))
    folders.add(["bad", log(3)])
    runs.compact_state(spark, folders.out, f"{folders.out}-compact")
    drain(runs.run_state(parsed(spark, folders), f"{folders.out}-compact", folders.checkpoint, drain=True))
    got = runs.current_state(spark, f"{folders.out}-compact", p, **sizes)
    want = snapshot.build(batch(spark, [*LOG, "bad", log(3)]), p, **sizes)
    assert row_set(got.counts) == row_set(want.counts)
    assert row_set(got.buckets) == row_set(want.buckets)
    assert row_set(got.cms.cells) == row_set(want.cms.cells)
    assert row_set(got.mg.rows) == row_set(want.mg.rows)
    assert row_set(got.ss.rows) == row_set(want.ss.rows)
    assert (got.cms.params, got.mg.capacity, got.ss.capacity, got.fresh) == (p, 50, 40, False)
    assert runs.current_state(spark, f"{folders.out}-none").fresh


def test_retention_of_a_stream(spark, folders):
    for part in ([log(s) for s in range(0, 20)], [log(s) for s in range(15, 30)], [log(30)], [log(31)]):
        folders.add(part)
        drain(runs.run_state(parsed(spark, folders), folders.out, folders.checkpoint, drain=True))
        buckets = runs.current_state(spark, folders.out, retention=5).buckets
        got = sorted(s for s, _ in row_set(buckets.select(F.second("sec"), "n")))
        assert got == [s for s in range(got[-1] - 4, got[-1] + 1)]
    runs.compact_state(spark, folders.out, f"{folders.out}-compact", retention=5)
    kept = runs.state_table(f"{folders.out}-compact").rows(spark)
    assert kept.where("dim = 'second'").count() == 6  # five up to second 30, and the newest batch as it was
    assert runs.current_state(spark, f"{folders.out}-compact").counts.where("dim = 'total'").first()["n"] == 37


def test_a_reset_takes_effect_at_one_place_of_the_input(spark, folders):
    at = [dt.datetime(2025, 9, 24, 10, 0, s, tzinfo=dt.timezone.utc) for s in (20, 40)]
    folders.add([log(s) for s in range(0, 30)] + ["bad"])
    drain(runs.run_state(parsed(spark, folders), folders.out, folders.checkpoint, drain=True))
    assert runs.current_state(spark, folders.out).counts.where("dim = 'total'").first()["n"] == 30
    runs.reset(spark, folders.out, at[0])  # of a time that has come already: only what is counted from now on is split by it
    folders.add([log(s) for s in range(10, 50)] + ["bad", "bad"])
    drain(runs.run_state(parsed(spark, folders), folders.out, folders.checkpoint, drain=True))

    def found(path):
        state_now = runs.current_state(spark, path)
        counted = {r.dim: r.n for r in state_now.counts.where("dim IN ('total', 'error')").collect()}
        return counted, sorted(s for s, _ in row_set(state_now.buckets.select(F.second("sec"), "n")))

    assert found(folders.out) == ({"total": 30, "error": 2}, list(range(20, 50)))
    runs.compact_state(spark, folders.out, f"{folders.out}-compact")
    assert found(f"{folders.out}-compact") == found(folders.out)
    runs.reset(spark, folders.out, at[1])
    assert found(folders.out) == ({}, [])
    folders.add([log(s) for s in (5, 39, 40, 41)])
    drain(runs.run_state(parsed(spark, folders), folders.out, folders.checkpoint, drain=True))
    assert found(folders.out) == ({"total": 2}, [40, 41])


def test_heads_go_on_from_batch_to_batch(spark, folders):
    """A key climbs into the head by small steps, while others stay; every batch is held against the exact counts."""
    done = []
    for k in range(6):
        part = [f'c{(i * (k + 3)) % 11} - - [24/Sep/2025:10:00:00 +0000] "GET /p{i % 4} H" {200 + i % 2}' for i in range(40)]
        part += [f'riser - - [24/Sep/2025:10:00:00 +0000] "GET /p{k} H" 200'] * 3 * k
        folders.add(part)
        done += part
        drain(runs.run_top(parsed(spark, folders), folders.out, folders.checkpoint, 3, drain=True, state_partitions=1))
        exact = row_set(counts.all_counts(batch(spark, done)))
        want = {r for r in exact if r[0] not in ("ip", "endpoint")}
        for dim in ("ip", "endpoint"):
            want |= set(sorted((r for r in exact if r[0] == dim), key=lambda r: (-r[2], r[1]))[:3])
        assert row_set(runs.current_heads(spark, folders.out)) == want


def test_a_refresh_reads_the_heads_and_the_batch_only(spark, tmp_path):
    heads = runs.heads_table(str(tmp_path / "t"))
    heads.write(spark.createDataFrame([("ip", "a", 5)], COUNT_ROW), 0)
    changed = spark.createDataFrame([("ip", "b", 9), ("second", "100", 1), ("second", "50", 1), ("status", "200", 4)], COUNT_ROW)
    found = runs.next_heads(heads.newest(spark, before=1), changed, 1, 10)
    assert row_set(found) == {("ip", "b", 9), ("second", "100", 1), ("status", "200", 4)}
    read = {f.rsplit("/", 2)[-2] for f in found.inputFiles()}
    assert read == {"batch_id=0"} and all("/t/heads/" in f for f in found.inputFiles())


def test_report_follows_the_stream(spark, folders):
    for part in (LOG[:100], LOG[100:]):
        folders.add(part)
        query = runs.run_report(
            parsed(spark, folders), folders.out, folders.checkpoint, k=1, drain=True, state_partitions=1, as_of_newest=True
        )
        drain(query)
        text = [v for _, v in sorted(rows(runs.current_report(spark, folders.out)))]
        done = LOG[: 100 if part[0] == LOG[0] else 200]
        assert f"accesslog_total_lines {sum(not v.startswith('bad') for v in done)}" in text


# --- the tail source -------------------------------------------------------------------------------------------


class Tail:
    """The reader driven by hand, as a query does: offsets in, lines out."""

    def __init__(self, path, **options):
        self.options = {"path": str(path), **options}
        self.reader = TailReader(self.options)
        self.offset = self.reader.initialOffset()

    def restart(self):
        self.reader = TailReader(self.options)

    def poll(self) -> list[str]:
        end = self.reader.latestOffset()
        parts = self.reader.partitions(self.offset, end)
        self.offset = end
        return [line for part in parts for block in read_lines(part) for line in block.to_pylist()]


def append(path, data: str):
    with open(path, "ab") as f:
        f.write(data.encode())


def test_tail_waits_for_the_file_and_for_whole_lines(tmp_path):
    path = tmp_path / "a.log"
    tail = Tail(path)
    assert tail.poll() == []
    append(path, "one\ntwo")
    assert tail.poll() == ["one"]
    append(path, " more\r\n\n")
    assert tail.poll() == ["two more\r", ""]
    assert tail.poll() == []


def test_tail_restart_reads_nothing_twice(tmp_path):
    path = tmp_path / "a.log"
    append(path, "1\n2\n")
    tail = Tail(path)
    assert tail.poll() == ["1", "2"]
    tail.restart()
    append(path, "3\n")
    assert tail.poll() == ["3"]


def test_tail_truncation(tmp_path):
    path = tmp_path / "a.log"
    append(path, "old 1\nold 2\n")
    tail = Tail(path)
    tail.poll()
    os.truncate(path, 0)
    append(path, "new\n")
    assert tail.poll() == ["new"]
    tail.restart()
    os.truncate(path, 0)
    append(path, "x\n")
    assert tail.poll() == ["x"]
    append(path, "y\n")
    assert tail.poll() == ["y"]


def test_tail_rotation_by_rename(tmp_path):
    path = tmp_path / "a.log"
    append(path, "1\n2\n")
    tail = Tail(tmp_path / "a.log*")
    assert tail.poll() == ["1", "2"]
    append(path, "3\n")
    os.rename(path, tmp_path / "a.log.1")
    append(path, "4\n")
    assert sorted(tail.poll()) == ["3", "4"]
    append(path, "5\n")
    assert tail.poll() == ["5"]


def test_tail_file_replaced_by_a_longer_one_with_the_same_inode(tmp_path):
    path = tmp_path / "a.log"
    append(path, "oldA\nB\n")
    tail = Tail(path)
    assert tail.poll() == ["oldA", "B"]
    with open(path, "r+b") as f:  # the inode stays, as it may when a file is deleted and written anew
        f.write(b"newA\nnewB\nnewC\n")
    assert tail.poll() == ["newA", "newB", "newC"]
    tail.restart()
    with open(path, "r+b") as f:
        f.write(b"third A\nB\nand more of it\n")
    assert tail.poll() == ["third A", "B", "and more of it"]


def test_tail_file_that_goes_on_in_the_middle_of_a_line(tmp_path):
    path = tmp_path / "a.log"
    append(path, "same start\nB\n")
    tail = Tail(path)
    tail.poll()
    with open(path, "r+b") as f:
        f.write(b"same start, but longer lines\nC\n")
    assert tail.poll() == ["same start, but longer lines", "C"]


def test_tail_keeps_bytes_and_rejects_unknown_schemes(spark, tmp_path):
    path = tmp_path / "a.log"
    with open(path, "wb") as f:
        f.write(b"a\xff\n\n\xe9\r\n")
    reader = TailReader({"path": str(path)})
    (part,) = reader.partitions({}, reader.latestOffset())
    assert [x.as_buffer().to_pybytes() for block in read_lines(part) for x in block.cast("binary")] == [b"a\xff", b"", b"\xe9\r"]
    for bad in ("nosuch://bucket/a.log", "hdfs:a"):
        with pytest.raises(ValueError):
            stream_tail(spark, bad)


def test_tail_follows_a_uri(tmp_path):
    for prefix in ("file:", "file://"):
        path = tmp_path / f"{len(prefix)}.log"
        tail = Tail(f"{prefix}{tmp_path}/{len(prefix)}.*")
        assert tail.poll() == []
        append(path, "1\n2")
        assert tail.poll() == ["1"]
        tail.restart()
        append(path, "\n3\n")
        assert tail.poll() == ["2", "3"]


def test_tail_patterns(tmp_path):
    for name in ("a/x.log", "a/y.log", "b/x.log", "a/deep/x.log", ".hidden.log", "top.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        append(tmp_path / name, name + "\n")
    for pattern in ("*.log", "*/x.log", "a/*", "[ab]/*.log", "a/?.log", "none/*.log", "top.log", "*/*/x.log"):
        want = sorted(os.path.relpath(p, tmp_path) for p in glob.glob(f"{tmp_path}/{pattern}") if os.path.isfile(p))
        assert sorted(Tail(f"{tmp_path}/{pattern}").poll()) == want, pattern


def test_tail_rotation_through_copies(tmp_path):
    """An object store has no rename: the file is copied to another name and the old name is written anew."""
    path = tmp_path / "a.log"
    append(path, "1\n2\n")
    tail = Tail(tmp_path / "a.log*")
    assert tail.poll() == ["1", "2"]
    append(path, "3\n")
    (tmp_path / "a.log.1").write_bytes(path.read_bytes())
    path.write_bytes(b"4\n")
    tail.restart()
    assert sorted(tail.poll()) == ["3", "4"]
    append(path, "5\n")
    append(tmp_path / "a.log.1", "last\n")
    assert sorted(tail.poll()) == ["5", "last"]


def test_tail_reads_nothing_of_files_that_did_not_change(tmp_path, monkeypatch):
    for i in range(5):
        append(tmp_path / f"{i}.log", f"{i}\n")
    tail = Tail(tmp_path / "*.log")
    tail.poll()
    opened = []
    real = tail_module._File.__init__
    monkeypatch.setattr(tail_module._File, "__init__", lambda self, system, path: (opened.append(path), real(self, system, path))[1])
    assert tail.poll() == [] and opened == []
    append(tmp_path / "3.log", "more\n")
    assert tail.poll() == ["more"] and {os.path.basename(p) for p in opened} == {"3.log"}


def test_tail_skips_a_file_that_is_gone(tmp_path, monkeypatch):
    append(tmp_path / "a.log", "1\n")
    append(tmp_path / "gone", "2\n")
    reader = TailReader({"path": str(tmp_path / "*")})
    infos = tail_module.listed(reader.system, reader.pattern)
    os.remove(tmp_path / "gone")
    monkeypatch.setattr(tail_module, "listed", lambda *_: infos)
    assert list(reader.latestOffset()) == [str(tmp_path / "a.log")]


def test_tail_file_renamed_between_plan_and_read(tmp_path):
    path = tmp_path / "a.log"
    append(path, "1\n")
    reader = TailReader({"path": str(path)})
    (part,) = reader.partitions({}, reader.latestOffset())
    os.rename(path, tmp_path / "b.log")
    append(path, "other\n")
    assert [block.to_pylist() for block in read_lines(part)] == [["1"]]
    os.truncate(tmp_path / "b.log", 0)
    with pytest.raises(OSError):
        list(read_lines(part))


@pytest.mark.parametrize("size", [1, 2, 5, 7, 1_000])
def test_tail_ranges_cover_every_line_once(tmp_path, size):
    path = tmp_path / "a.log"
    want = ["x" * (i * 7 % 13) for i in range(40)]
    append(path, "\n".join(want) + "\n")
    tail = Tail(path, maxBytesPerPartition=str(size))
    assert tail.poll() == want


def test_tail_batch_limit(tmp_path):
    path = tmp_path / "a.log"
    append(path, "aaaa\nbb\nc\n" + "d" * 50 + "\ne\n")
    tail = Tail(path, maxBytesPerBatch="8")
    polls = [tail.poll() for _ in range(5)]
    assert polls == [["aaaa", "bb"], ["c"], ["d" * 50], ["e"], []]


def offset_log(folder, number: int, offset: dict):
    (folder / "offsets").mkdir(exist_ok=True, parents=True)
    (folder / "offsets" / str(number)).write_text(f"v1\n{{}}\n{json.dumps(offset)}")


def test_tail_limit_holds_for_the_first_batch_after_a_restart(tmp_path):
    path, checkpoint = tmp_path / "a.log", tmp_path / "cp"
    append(path, "aaaa\nbb\n")
    tail = Tail(path, maxBytesPerBatch="8", checkpoint=str(checkpoint))
    assert tail_module.committed_offset(str(checkpoint)) is None
    assert tail.poll() == ["aaaa", "bb"]
    offset_log(checkpoint, 9, {})
    offset_log(checkpoint, 10, tail.offset)
    append(path, "c" * 4 + "\n" + "d" * 4 + "\n" + "e\n")
    tail.restart()
    assert [tail.poll() for _ in range(3)] == [["cccc"], ["dddd", "e"], []]


def test_tail_query_obeys_the_limit_after_a_restart(spark, tmp_path):
    path, checkpoint = tmp_path / "live.log", str(tmp_path / "cp")
    for part in (LOG[:40], LOG[40:]):
        append(path, "".join(v + "\n" for v in part))
        tail = stream_tail(spark, f"file:{path}", max_bytes=2_000, checkpoint=checkpoint)
        query = tail.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
        query.processAllAvailable()
        sizes = [p.numInputRows for p in query.recentProgress]
        query.stop()
        assert sum(sizes) == len(part) and max(sizes) <= 2_000 // 40
    assert query.exception() is None


def test_tail_query_with_restart(spark, tmp_path):
    path, out, checkpoint = tmp_path / "live.log", str(tmp_path / "out"), str(tmp_path / "cp")
    done = []
    for part in (LOG[:60], LOG[60:61], LOG[61:]):
        append(path, "".join(v + "\n" for v in part))
        append(path, "half a line")
        source = parse_logs(stream_tail(spark, str(path), range_bytes=500), event_clock=True)
        drain(runs.run_counts(source, out, checkpoint, drain=True, state_partitions=1))
        done += part
        assert row_set(runs.current_counts(spark, out)) == row_set(counts.all_counts(batch(spark, done)))
        os.truncate(path, os.path.getsize(path) - len("half a line"))
