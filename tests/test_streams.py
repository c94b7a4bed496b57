"""Streams over several micro-batches: every stream query equals its SQL, state keeps its types, and state ends."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from scribewell.operators import providers
from scribewell.plans import table_queries
from scribewell.sources import tables
from scribewell.streaming import processors, streams
from tests.oracle import SF_DIR, connect, difference, plain

SQL = table_queries.oracle_sql()
#: Those that cut their batches themselves.
OWN = {"stream_recorded_windows", "stream_transcripts", "stream_shed_windows", "stream_state_last"}


@pytest.fixture(scope="module")
def eight(spark, tmp_path_factory):
    """Events in eight files by time and embeddings in four by number, one file a trigger."""
    base = tmp_path_factory.mktemp("eight")
    for name, by, n in (("events", "ts", 8), ("embeddings", "vec_id", 4)):
        folder = base / f"{name}.parquet"
        tables.table(spark, SF_DIR, name).repartitionByRange(n, by).write.parquet(str(folder))
        for k, file in enumerate(sorted(folder.glob("part-*"))):
            os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    # a table whose name begins the same is another table
    spark.range(3).write.parquet(str(base / "events_more.parquet"))
    return str(base)


@pytest.mark.parametrize("name", sorted(n for n in table_queries.queries() if n.startswith("stream_") and n not in OWN))
def test_many_batches_give_the_same(spark, eight, name, monkeypatch):
    monkeypatch.setattr(streams, "FILES", 1)
    assert difference(spark, table_queries.queries()[name], SQL[name], eight) == ""


def test_the_batches_are_many(spark, eight, monkeypatch):
    monkeypatch.setattr(streams, "FILES", 1)
    assert streams.drained(streams.routed(streams.message_stream(spark, eight))).select("batch_id").distinct().count() == 8


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def stream_of(spark, rows, schema, batches):
    """Rows (batch, stream_id, hours, ...) as a stream of those batches."""
    df = spark.createDataFrame([(b, s, at(h), *rest) for b, s, h, *rest in rows], f"batch int, stream_id long, ts timestamp, {schema}")
    return streams.replayed(df, "batch", batches=batches).drop("batch")


def run(stream):
    """What a stream gives, and the rows of its state after each batch."""
    spark = stream.sparkSession
    held = []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{streams.shared_folder(spark)}/check-{streams.uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(lambda df, _: held.extend(df.collect())).start()
    query.awaitTermination(300)
    return held, [p.stateOperators[0].numRowsTotal for p in query.recentProgress]


@pytest.mark.parametrize(("kind", "values"), [("bigint", [2**60 + 1, 7]), ("double", [0.1, 2.5]), ("string", ["é", ""]), ("boolean", [False, True]), ("array<int>", [[1, 2], []]), ("struct<a:bigint,b:string>", [(2**60 + 1, "x"), (1, "y")]), ("date", [datetime.date(2024, 5, 1), datetime.date(1, 1, 1)])])
def test_settings_keep_their_type_over_batches(spark, kind, values):
    one, two = values
    rows = [(0, 1, 0, 1, 0, one), (0, 2, 0, 2, 1, None), (1, 1, 1, 3, 1, None), (2, 1, 2, 4, 0, None), (2, 1, 3, 5, 1, None), (3, 1, 4, 6, 0, two), (3, 1, 5, 7, 1, None)]
    found, _ = run(processors.settings_at(stream_of(spark, rows, f"seq long, kind int, value {kind}", 4)))
    assert {r["seq"]: r["value"] for r in found} == {2: None, 3: one, 5: one, 7: two}


def test_state_ends_when_nothing_comes(spark):
    hour = 3_600_000
    rows = [(0, s, 0, s, 0, 10 * s) for s in range(1, 21)] + [(1, 99, 30, 100, 0, 1), (2, 99, 60, 101, 1, None), (3, 5, 61, 102, 1, None), (4, 99, 90, 103, 1, None)]
    found, held = run(processors.settings_at(stream_of(spark, rows, "seq long, kind int, value long", 5), idle_ms=10 * hour))
    # the stream that came back had been forgotten
    assert {r["seq"]: r["value"] for r in found} == {101: None, 102: None, 103: None}
    assert held[0] >= 40 and held[-1] <= 6
    # without a pause that is long enough the state stays, over batches and in one
    steps = [(0, 1, 0, 1, 0, 7)] + [(1 + h // 30, 1, 6 * h, 1 + h, 1, None) for h in range(1, 60)]
    for batches in (1, 3):
        found, _ = run(processors.settings_at(stream_of(spark, steps, "seq long, kind int, value long", batches), idle_ms=10 * hour))
        assert {r["value"] for r in found} == {7}
    kept, held = run(processors.settings_at(stream_of(spark, rows, "seq long, kind int, value long", 5)))
    assert {r["seq"]: r["value"] for r in kept} == {101: 1, 102: 50, 103: 1}
    assert held[-1] >= 40


def test_trailing_samples_end_too(spark):
    rows = [(0, s, 0, s, [1.0] * 5) for s in range(1, 11)] + [(1, 99, 30, 100, [2.0]), (2, 99, 60, 101, [3.0] * 4), (3, 1, 61, 102, [4.0])]
    found, held = run(processors.trailing_samples(stream_of(spark, rows, "seq long, samples array<float>", 4), 4, idle_ms=3_600_000))
    assert {r["seq"]: r["samples"] for r in found if r["seq"] > 99} == {100: [2.0], 101: [3.0] * 4, 102: [4.0]}
    assert held[0] >= 20 and held[-1] <= 6


def test_idle_recorders_and_gone_notices_have_no_state(spark):
    rows = [(0, s, 0, s, "start-transcription") for s in range(1, 11)] + [(1, s, 1, 20 + s, "stop-transcription") for s in range(1, 10)]
    found, held = run(streams.recorder(stream_of(spark, rows, "seq long, type string", 2)))
    assert len(found) == 19 and held[:2] == [10, 1]
    rows = [(0, s, 0, s, "ADD", "a", "t") for s in range(1, 11)] + [(1, s, 1, 20 + s, "REMOVE", None, None) for s in range(1, 9)]
    log = stream_of(spark, rows, "seq long, action string, id string, title string", 2)
    held = []
    query = streams.notices_kept(log).writeStream.outputMode("update").option("checkpointLocation", f"{streams.shared_folder(spark)}/check-{streams.uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(lambda df, _: held.append(df.count())).start()
    query.awaitTermination(300)
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress][:2] == [10, 2]


def test_a_snapshot_begins_the_state(spark):
    snapshot = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "stream_id long, value long")
    # an update of the first batch takes the place of its row; a value that is null or older changes nothing
    rows = [(0, 1, 5, 1, 11), (0, 4, 5, 2, 40), (1, 2, 6, 3, None), (1, 1, 4, 4, 99), (2, 2, 7, 5, 21), (2, 1, 7, 6, 12)]
    found, _ = run(processors.last_values(stream_of(spark, rows, "seq long, value long", 3), snapshot))
    assert sorted((r["stream_id"], r["seq"], r["value"]) for r in found if r["at"] is not None) == [(1, 1, 11), (1, 6, 12), (2, 5, 21), (4, 2, 40)]
    assert sorted((r["stream_id"], r["value"]) for r in found if r["at"] is None) == [(2, 20), (3, 30)]


def test_windows_of_a_recorder(spark):
    shape = "seq long, kind string, value string, samples array<float>"
    one = lambda n, x: [float(x)] * n
    rows = [
        (0, 1, 0, 1, "chunk", None, one(3, 1)),  # nothing is recorded yet
        (0, 1, 1, 2, "setting", "de", None),
        (1, 1, 2, 3, "start", None, None),
        (1, 1, 3, 4, "setting", "fr", None),  # no samples to look at
        (1, 1, 4, 5, "chunk", None, one(3, 5)),
        (2, 1, 5, 6, "chunk", None, []),
        (2, 1, 6, 7, "start", None, None),  # it runs already
        (2, 1, 7, 8, "chunk", None, one(3, 8)),
        (3, 1, 8, 9, "setting", "es", None),  # looks once more
        (3, 1, 9, 10, "stop", None, None),
        (3, 1, 10, 11, "chunk", None, one(2, 11)),
        (4, 1, 11, 12, "setting", "it", None),
        (4, 1, 12, 13, "start", None, None),
        (4, 1, 13, 14, "chunk", None, one(1, 14)),
    ]
    found, _ = run(processors.recorded_windows(stream_of(spark, rows, shape, 5), 4))
    assert [(r["seq"], r["cause"], r["session"], r["setting"], r["oldest"], r["samples"]) for r in found] == [
        (5, "chunk", 1, "fr", 5, [5.0] * 3),
        (8, "chunk", 1, "fr", 5, [5.0, 8.0, 8.0, 8.0]),
        (9, "setting", 1, "es", 5, [5.0, 8.0, 8.0, 8.0]),
        (14, "chunk", 2, "it", 14, [14.0]),
    ]
    newest, _ = run(processors.recorded_windows(stream_of(spark, rows, shape, 2), 4, newest_only=True))
    assert sum(r["n_waiting"] for r in newest) == 4 and len(newest) == 2


def test_windows_in_batch_have_the_samples_of_the_stream(spark):
    """The samples themselves, against a fold of the events in order."""
    events = table_queries._recorder_events(tables.messages(tables.table(spark, SF_DIR, "events"))).collect()
    state, expected = {}, {}
    for e in sorted(events, key=lambda e: (e["ts"], processors.KINDS.index(e["kind"]), e["seq"])):
        s = state.setdefault(e["stream_id"], {"on": False, "samples": []})
        if e["kind"] == "start" and not s["on"]:
            s.update(on=True, samples=[])
        elif e["kind"] == "stop":
            s["on"] = False
        elif e["kind"] == "chunk" and s["on"] and e["samples"]:
            s["samples"] = (s["samples"] + e["samples"])[-table_queries.N :]
        if s["on"] and s["samples"] and (e["kind"] == "setting" or e["kind"] == "chunk" and e["samples"]):
            expected[e["seq"]] = s["samples"]
    found = streams.drained(processors.recorded_windows(table_queries._recorder_events(table_queries._replayed_messages(spark, SF_DIR, 3)), table_queries.N)).collect()
    assert {r["seq"]: r["samples"] for r in found} == expected


def test_own_batches(spark):
    con = connect(SF_DIR)
    for name in ("stream_recorded_windows", "stream_shed_windows"):
        n = con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0]
        assert plain(n) > 20


def test_recorders_of_a_bucket_keep_apart(spark):
    """Streams that share a bucket's state, null and large ones too, give what each gives by itself; what is idle leaves the state."""
    streams_, shape = [1, 2, None, 2**60 + 1, 0], "seq long, kind string, value struct<a:bigint>, samples array<float>"
    rows = []
    for n, s in enumerate(streams_):
        rows += [(0, s, 0, 10 * n, "start", None, None), (0, s, 1, 10 * n + 1, "setting", (n,), None), (1, s, 2, 10 * n + 2, "chunk", None, [float(n)] * 3), (2, s, 3, 10 * n + 3, "chunk", None, [0.5] * 2)]
    rows += [(3, 1, 60, 90, "start", None, None), (4, 1, 120, 91, "chunk", None, [7.0])]
    want = {(s, 10 * n + 2, 1, (n,), 10 * n + 2, (float(n),) * 3) for n, s in enumerate(streams_)} | {(s, 10 * n + 3, 1, (n,), 10 * n + 2, (float(n),) * 2 + (0.5,) * 2) for n, s in enumerate(streams_)}
    for buckets in (1, 4096):
        found, held = run(processors.recorded_windows(stream_of(spark, rows, shape, 5), 4, idle_ms=24 * 3_600_000, buckets=buckets))
        assert {(r["stream_id"], r["seq"], r["session"], tuple(r["setting"]), r["oldest"], tuple(r["samples"])) for r in found} == want
        # the bucket of null streams stands by itself; what came back after the pause had been forgotten, so it doesn't record
        assert held[0] == (2 if buckets == 1 else 5) and held[-1] <= 1


def many_streams(spark, batches):
    """Three hundred streams, each with a start and two chunks."""
    rows = [(b, s, b, 10 * s + b, kind, None, samples) for s in range(300) for b, kind, samples in ((0, "start", None), (1, "chunk", [1.0] * (s % 5 + 1)), (2, "chunk", [2.0] * 2))]
    return stream_of(spark, rows, "seq long, kind string, value long, samples array<float>", batches)


def test_transcripts_of_many_streams_have_a_state_for_each_bucket(spark):
    windows = processors.recorded_windows(many_streams(spark, 3), 4, buckets=8)
    asked = windows.withColumn("language", F.lit("ru")).withColumn("task", F.lit("transcribe"))
    found, held = run(providers.transcribed(asked, [providers.StubTranscriber], also=("seq", "session")))
    sizes = {(s, 10 * s + b): min(s % 5 + n, 4) for s in range(300) for b, n in ((1, 1), (2, 3))}
    assert len(found) == 600 and {(r["stream_id"], r["seq"]): r["outputs"] for r in found} == {k: [f"[stub transcribe ru: {n} samples]"] for k, n in sizes.items()}
    assert max(held) <= 8


def test_shed_windows_of_many_streams_have_a_state_for_each_bucket(spark):
    found, held = run(processors.recorded_windows(many_streams(spark, 1), 4, newest_only=True, buckets=8))
    assert sorted((r["stream_id"], r["seq"], len(r["samples"]), r["n_waiting"]) for r in found) == [(s, 10 * s + 2, min(s % 5 + 3, 4), 2) for s in range(300)]
    assert max(held) <= 8


def test_every_window_has_a_place_in_its_part(spark):
    """Parts that share a batch are told apart, none of their windows is lost, and the newest of each are those that shedding leaves."""
    rows = [(0, s, 0, 100 * s, "start", None, None) for s in (1, 2)]
    # hours 1 to 3 are part 0, hours 11 and 12 part 1, and hour 21 part 2; the first two parts are one batch
    rows += [(h // 20, s, h, 100 * s + h, "chunk", None, [float(h)] * 2) for s in (1, 2) for h in (1, 2, 3, 11, 12, 21)]
    part = F.hour("ts") / 10
    found, _ = run(processors.recorded_windows(stream_of(spark, rows, "seq long, kind string, value long, samples array<float>", 2), 3, part=part))
    want = {1: (3, 3), 2: (3, 2), 3: (3, 1), 11: (2, 2), 12: (2, 1), 21: (1, 1)}
    assert sorted((r["seq"], r["n_waiting"], r["place"]) for r in found) == [(100 * s + h, *x) for s in (1, 2) for h, x in want.items()]
    assert {(r["seq"], tuple(r["samples"])) for r in found if r["stream_id"] == 1} == {(101, (1.0, 1.0)), (102, (1.0, 2.0, 2.0)), (103, (2.0, 3.0, 3.0)), (111, (3.0, 11.0, 11.0)), (112, (11.0, 12.0, 12.0)), (121, (12.0, 21.0, 21.0))}
    newest, _ = run(processors.recorded_windows(stream_of(spark, rows, "seq long, kind string, value long, samples array<float>", 2), 3, newest_only=True, part=part))
    assert sorted((r["seq"], r["n_waiting"], r["place"], r["samples"][-1]) for r in newest) == [(100 * s + h, n, 1, h) for s in (1, 2) for h, n in ((3, 3), (12, 2), (21, 1))]


def test_shed_windows_are_all_there_over_many_weeks(spark, tmp_path):
    """Thirty weeks, which are more than the batches: the rows are the SQL's, and as many as there are windows."""
    events = tables.table(spark, SF_DIR, "events")
    begin = F.lit("2024-01-01").cast("timestamp")
    micros = F.unix_micros(begin) + (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(begin)) * 7
    events.withColumn("ts", F.timestamp_micros(micros).cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    query, con = table_queries.queries()["stream_shed_windows"], connect(str(tmp_path))
    assert con.execute("SELECT count(DISTINCT date_trunc('week', ts)) FROM events").fetchone()[0] > 20
    assert difference(spark, query, SQL["stream_shed_windows"], str(tmp_path)) == ""
    windows = con.execute(f"SELECT seq FROM ({SQL['stream_recorded_windows']})").fetchall()
    assert sorted(r["seq"] for r in query(spark, str(tmp_path)).collect()) == sorted(x for x, in windows)
