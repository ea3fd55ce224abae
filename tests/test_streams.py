"""Streams give the same tables as a batch over the same rows, also after a replay or a restart."""

import os
from collections import Counter

import pytest

from evenhand.functions.hashing import draw_rows
from evenhand.operators.sketch import (
    cms_build,
    cms_table,
    cs_build,
    cs_table,
    frequency_tables,
    hist_table,
    item_hist,
)
from evenhand.sources.items import file_pattern, read_items
from evenhand.streaming import sketches as streams
from evenhand.streaming.sinks import BatchTable

ROWS = draw_rows(3, 8191, seed=4)
W = 16
ONCE = {"availableNow": True}
BATCHES = [[1, 2, 3, 3], [3, 3, 4], [5, 1], [9] * 6]


@pytest.fixture
def source(spark, tmp_path):
    """Text files, one per micro-batch, in order."""
    folder = tmp_path / "in"
    folder.mkdir()

    def build(batches=BATCHES):
        for batch in batches:
            number = len(list(folder.iterdir()))
            path = folder / f"{number:03d}.txt"
            path.write_text("".join(f"{x}\n" for x in batch))
            # File streams read in order of modification time.
            os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
        return read_items(spark, "text", {"path": str(folder), "maxFilesPerTrigger": "1"})

    return build


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_stateful_tables_equal_the_batch_result(spark, source, tmp_path):
    stream = source()
    items = spark.createDataFrame([(x,) for batch in BATCHES for x in batch], "item bigint")
    out = {name: str(tmp_path / name) for name in ("hist", "cms", "cs", "c1", "c2", "c3")}
    running = [
        streams.stream_hist(stream, out["hist"], out["c1"], trigger=ONCE),
        streams.stream_cms(stream, ROWS, W, out["cms"], out["c2"], 8191, trigger=ONCE),
        streams.stream_cs(stream, ROWS, W, out["cs"], out["c3"], 8191, trigger=ONCE),
    ]
    for query in running:
        query.awaitTermination()
    assert same(streams.read_hist(spark, out["hist"]), item_hist(items))
    assert same(streams.read_sketch(spark, out["cms"]), cms_build(items, ROWS, W, 8191))
    assert same(streams.read_sketch(spark, out["cs"]), cs_build(items, ROWS, W, 8191))


@pytest.mark.parametrize("t,taken", [(1, 1), (4, 1), (5, 2), (7, 2), (8, 3), (15, 4), (99, 4)])
def test_prefix_stops_after_the_crossing_batch(spark, source, tmp_path, t, taken):
    stream = source()
    run = streams.stream_sketches(stream, ROWS, W, t, str(tmp_path / "out"), str(tmp_path / "cp"), 8191, trigger=ONCE)
    assert run.wait() == (t <= 15)
    kept = [x for batch in BATCHES[:taken] for x in batch]
    items = spark.createDataFrame([(x,) for x in kept], "item bigint")
    assert {r.item: r.freq for r in run.hist().collect()} == Counter(kept)
    assert same(run.cms(), cms_build(items, ROWS, W, 8191))
    assert same(run.cs(), cs_build(items, ROWS, W, 8191))
    assert sum(r.n for r in run.progress().collect()) == len(kept)


def test_restart_continues_the_count(spark, source, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    first = streams.stream_sketches(source(BATCHES[:1]), ROWS, W, 8, out, checkpoint, 8191, trigger=ONCE)
    assert not first.wait()
    second = streams.stream_sketches(source(BATCHES[1:]), ROWS, W, 8, out, checkpoint, 8191, trigger=ONCE)
    assert second.wait()
    assert sum(r.n for r in second.progress().collect()) == 9
    third = streams.stream_sketches(source([[7] * 50]), ROWS, W, 8, out, checkpoint, 8191, trigger=ONCE)
    third.wait()
    assert sum(r.freq for r in third.hist().collect()) == 9


def test_continuous_run_is_left_once_t_is_reached(spark, source, tmp_path):
    run = streams.stream_sketches(source(), ROWS, W, 5, str(tmp_path / "out"), str(tmp_path / "cp"), 8191)
    assert run.wait(timeout=60)
    assert not run.query.isActive
    assert sum(r.freq for r in run.hist().collect()) == 7


def batch_table(spark, tmp_path, combine="sum", fanout=10):
    return BatchTable(spark, str(tmp_path / "sink"), "item bigint, freq bigint", ["item"], "freq", combine, fanout=fanout)


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "item bigint, freq bigint")


def contents(table):
    return {r.item: r.freq for r in table.read().collect()}


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    table = batch_table(spark, tmp_path)
    assert table.read().count() == 0 and table.folders() == []
    for _ in range(2):
        table.write(rows_of(spark, [(1, 2), (2, 3)]), 0)
    table.write(rows_of(spark, [(1, 2), (2, 3)]), 1)
    assert contents(table) == {1: 4, 2: 6}


@pytest.mark.parametrize("combine", ["sum", "last"])
def test_levels_merge_and_a_replay_changes_nothing(spark, tmp_path, combine):
    table, expected = batch_table(spark, tmp_path, combine, fanout=3), Counter()
    for batch in range(14):
        pairs = [(batch % 4, batch + 1), (batch + 100, 1)]
        for item, freq in pairs:
            expected[item] = freq if combine == "last" else expected[item] + freq
        assert table.n_before(batch) == 2 * batch
        assert table.write(rows_of(spark, pairs), batch, lambda rows: rows.count()) == 2
        assert table.n_before(batch + 1) == 2 * batch + 2
        # A replay of the latest batch, merged or not.
        table.write(rows_of(spark, pairs), batch, lambda rows: rows.count())
        assert contents(table) == expected
    spans = [(f.level, f.first, f.last, f.n) for f in table.folders()]
    assert spans == [(2, 0, 8, 18), (1, 9, 11, 6), (0, 12, 12, 2), (0, 13, 13, 2)]
    # An older one, with other rows: the batch was written whole before.
    assert table.write(rows_of(spark, [(1, 10**6)]), 4) == 0
    assert contents(table) == expected


def test_folders_that_were_merged_go_one_batch_later(spark, tmp_path):
    table = batch_table(spark, tmp_path, fanout=2)
    level = tmp_path / "sink" / "level=0"
    for batch, left in enumerate([{"0-0"}, {"0-0", "1-1"}, {"2-2"}]):
        table.write(rows_of(spark, [(batch, 1)]), batch)
        names = [p.name.removeprefix("batches=") for p in level.iterdir()]
        assert {name for name in names if not name.startswith(".")} == left
    assert contents(table) == {0: 1, 1: 1, 2: 1}


def test_a_batch_without_its_manifest_does_not_count(spark, tmp_path, monkeypatch):
    table = batch_table(spark, tmp_path, fanout=2)
    table.write(rows_of(spark, [(1, 1)]), 0)

    def lost(text):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(table._manifest, "replace", lost)
        with pytest.raises(OSError):
            table.write(rows_of(spark, [(1, 5)]), 1)
    assert contents(table) == {1: 1}
    table.write(rows_of(spark, [(1, 7)]), 1)
    assert contents(table) == {1: 8}


def test_bad_arguments_of_batch_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        batch_table(spark, tmp_path, "max")
    with pytest.raises(ValueError):
        batch_table(spark, tmp_path, fanout=1)


def test_one_shuffle_gives_all_three_tables(spark):
    items = spark.createDataFrame([(x,) for batch in BATCHES for x in batch] + [(None,), (-5,)], "item bigint")
    for source, shuffles in ((items, 1), (item_hist(items), 2)):
        tables = frequency_tables(source, ROWS, W, 8191)
        plan = tables._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles
        kept = items.where("item is not null")
        assert same(hist_table(tables), item_hist(items))
        assert same(cms_table(tables, W).where("d is not null"), cms_build(kept, ROWS, W, 8191))
        assert same(cs_table(tables, W).where("d is not null"), cs_build(kept, ROWS, W, 8191))


def test_stateful_tables_together(spark, source, tmp_path):
    out, items = str(tmp_path / "all"), spark.createDataFrame([(x,) for b in BATCHES for x in b], "item bigint")
    streams.stream_tables(source(), ROWS, W, out, str(tmp_path / "cp"), 8191, trigger=ONCE).awaitTermination()
    assert same(streams.read_tables(spark, out), frequency_tables(items, ROWS, W, 8191))


def test_one_query_until_t_over_parquet_files(spark, tmp_path, monkeypatch):
    """Two files for a micro-batch by the source's own limit, without a copy, started once."""
    for number, batch in enumerate(BATCHES):
        frame = spark.createDataFrame([(x, "other") for x in batch], "user bigint, y string")
        frame.coalesce(1).write.parquet(str(tmp_path / "part" / str(number)))
        (found,) = (tmp_path / "part" / str(number)).glob("*.parquet")
        os.utime(found, (1_700_000_000 + number, 1_700_000_000 + number))
    starts = []
    begin = streams.PrefixRun.start
    monkeypatch.setattr(streams.PrefixRun, "start", lambda run, writer: (starts.append(run), begin(run, writer)))
    options = {"path": str(tmp_path / "part" / "*"), "maxFilesPerTrigger": "2"}
    items = read_items(spark, "parquet", options, "user * 2", schema="user bigint, y string")
    run = streams.stream_sketches(items, ROWS, W, 5, str(tmp_path / "out"), str(tmp_path / "cp"), 8191)
    assert run.wait(timeout=120) and len(starts) == 1
    assert {r.item: r.freq for r in run.hist().collect()} == Counter(2 * x for b in BATCHES[:2] for x in b)
    assert [tuple(r) for r in run.progress().collect()] == [(0, 0, 7)]


def test_a_stream_that_runs_dry_is_left_when_idle(spark, source, tmp_path):
    run = streams.stream_sketches(source(), ROWS, W, 1000, str(tmp_path / "out"), str(tmp_path / "cp"), 8191)
    assert not run.wait(until_idle=True)
    assert run.rows == 15 and run.seen == 3 and not run.query.isActive
    assert sum(r.freq for r in run.hist().collect()) == 15


def test_an_error_of_a_batch_is_raised(spark, source, tmp_path):
    run = streams.stream_sketches(source([["x"]]), ROWS, W, 5, str(tmp_path / "out"), str(tmp_path / "cp"), 8191)
    with pytest.raises(Exception, match="64-bit integer"):
        run.wait(timeout=120)


def test_a_single_file_can_be_streamed(spark, tmp_path):
    (tmp_path / "one.txt").write_text("1\n2\n1\n")
    items = read_items(spark, "text", {"path": file_pattern(str(tmp_path / "one.txt"))})
    run = streams.stream_sketches(items, ROWS, W, 2, str(tmp_path / "out"), str(tmp_path / "cp"), 8191, trigger=ONCE)
    assert run.wait()
    assert {r.item: r.freq for r in run.hist().collect()} == {1: 2, 2: 1}


def test_t_must_be_positive(spark, source, tmp_path):
    with pytest.raises(ValueError):
        streams.stream_sketches(source(), ROWS, W, 0, str(tmp_path / "out"), str(tmp_path / "cp"))


def test_batch_reading_of_the_same_files(spark, source, tmp_path):
    source()
    items = read_items(spark, "text", {"path": str(tmp_path / "in")}, streaming=False)
    assert {r.item: r.freq for r in item_hist(items).collect()} == Counter(x for b in BATCHES for x in b)
