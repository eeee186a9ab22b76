"""The compacted run log against a full scan of its events."""

import itertools

import pytest

from assay.operators.runs import latest_runs, merged_metrics
from assay.schemas import RUN_EVENT
from assay.sources import records
from assay.sources.run_log import RunLog
from assay.streaming.status import current_runs, stream_events, watch_runs

STATUSES = ["planned", "training", "complete", "failed", "no such status", None]


def batch_of(number):
    """Late, repeated and tied events, runs without an id, unset and null metrics."""
    rows = []
    for i in range(12):
        n = number * 7 + i
        run = None if n % 11 == 0 else f"r{n % 4}"
        metrics = None if n % 5 == 0 else {"r2": float(n % 3), "loss": None if n % 4 == 0 else n / 2}
        rows.append((run, (n * 5) % 17, STATUSES[n % 6], metrics, f"e{n}" if n % 3 == 0 else None))
    return rows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, batches):
    return spark.createDataFrame([r for b in batches for r in b], RUN_EVENT).coalesce(1)


def assert_equals_scan(log, spark, batches):
    events = frame(spark, batches)
    assert rows(log.latest()) == rows(latest_runs(events))
    assert rows(log.metrics()) == rows(merged_metrics(events))


def test_equal_to_a_scan_after_every_step(spark, tmp_path):
    log, seen = RunLog(spark, str(tmp_path / "log")), []
    for number, (compact, vacuum) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (1, 1)]):
        seen.append(batch_of(number))
        log.append(frame(spark, seen[-1:]))
        if compact:
            assert log.compact()
            assert log.pending() == []
        if vacuum:
            log.vacuum()
        assert_equals_scan(log, spark, seen)
    log.compact(full=True)
    log.vacuum()
    assert len(log.versions()) == 1
    assert log.compact() is None
    assert_equals_scan(log, spark, seen)


def test_repeated_batches_and_empty_ones_change_nothing(spark, tmp_path):
    log, batches = RunLog(spark, str(tmp_path / "log")), [batch_of(0), batch_of(1)]
    log.append(frame(spark, [[]]))
    assert log.latest().collect() == []
    log.append(frame(spark, batches))
    log.compact()
    log.append(frame(spark, batches[1:]))
    assert_equals_scan(log, spark, batches)
    log.compact()
    assert_equals_scan(log, spark, batches)


def test_compaction_that_dies_between_its_steps(spark, tmp_path, monkeypatch):
    log, batches = RunLog(spark, str(tmp_path / "log")), [batch_of(0), batch_of(1)]
    log.append(frame(spark, batches[:1]))
    log.compact()
    log.append(frame(spark, batches[1:]))

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(RunLog, "_commit", die)
        with pytest.raises(OSError):
            log.compact()
    assert len(log.versions()) == 1 and log.pending()
    assert_equals_scan(log, spark, batches)
    log.compact()
    assert_equals_scan(log, spark, batches)

    # A vacuum that dies after any of its deletions can be finished by the next one.
    delete = RunLog._delete
    for stop in itertools.count():
        left = iter(range(stop))

        def some(self, name, left=left):
            if next(left, None) is None:
                raise OSError("lost")
            delete(self, name)

        with monkeypatch.context() as m:
            m.setattr(RunLog, "_delete", some)
            try:
                log.vacuum()
                break
            except OSError:
                assert_equals_scan(log, spark, batches)
    assert_equals_scan(log, spark, batches)


def test_two_compactions_at_a_time(spark, tmp_path, monkeypatch):
    log, batches = RunLog(spark, str(tmp_path / "log")), [batch_of(n) for n in range(3)]
    log.append(frame(spark, batches[:1]))
    log.compact()
    log.append(frame(spark, batches[1:2]))
    commit = RunLog._commit

    def overtaken(self, name, parents, files):
        monkeypatch.setattr(RunLog, "_commit", commit)
        self.append(frame(spark, batches[2:]))
        self.compact()
        self.vacuum()
        commit(self, name, parents, files)

    monkeypatch.setattr(RunLog, "_commit", overtaken)
    log.compact()
    assert len([v for v in log.versions()]) >= 2
    assert_equals_scan(log, spark, batches)
    log.compact(full=True)
    log.vacuum()
    assert len(log.versions()) == 1
    assert_equals_scan(log, spark, batches)


def test_large_heads_are_left_alone(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    many = [(f"x{i}", 1, "training", {}, None) for i in range(50)]
    log.append(frame(spark, [many]))
    first = log.compact()
    log.append(frame(spark, [[("y", 1, "complete", {}, None)]]))
    log.compact()
    versions = {v.name: v for v in log.versions()}
    assert len(versions) == 2 and all(first not in v.parents for v in versions.values())
    assert log.latest().count() == 51


def test_stream_into_few_files(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("source", "table", "state"))
    batches = [batch_of(n) for n in range(5)]
    for b in batches:
        records.append_events(frame(spark, [b]), source)
    stream = stream_events(spark, source, files_per_batch=1)
    watch_runs(stream, table, state, compact_every=2).awaitTermination()
    log = RunLog(spark, table)
    assert rows(current_runs(spark, table)) == rows(latest_runs(frame(spark, batches)))
    assert len({f for f in log.pending()}) <= 8 and len(log.versions()) <= 2
