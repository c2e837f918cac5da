import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.session import Scratch
from causeway.functions import event_fields as ef
from causeway.operators import dedup, ordered, resolution, runs, tables, validation
from causeway.operators.ingest import ingest, key_text, settle
from causeway.sources import events as event_source
from causeway.sources import table_store
from causeway.sources.table_store import ExpiringKeys, KeyedTable
from causeway.streaming import ingest as stream_ingest, reports
from causeway.streaming.ingest import LineageStore
from causeway.streaming.keyed_state import KeepOnce, start_dedup
from causeway.workload.name_queries import read_batches
from causeway.workload.registry import Given

T0 = dt.datetime(2024, 1, 1)
TERMINAL = ("COMPLETE", "FAIL", "ABORT")
RESOLUTIONS = (
    "test_result_id string, status string, resolved_by string, resolution_reason string, resolution_note string, "
    "resolved_by_test_result_id string, mute_expires_at timestamp, updated_at timestamp")
SPEC = "https://openlineage.io/spec/2-0-2/OpenLineage.json"


def event_rows(seed, n_runs, n_events):
    rng = random.Random(seed)
    kinds = ["START", "RUNNING", "COMPLETE", "FAIL", "OTHER"]
    return [
        (f"r{min(rng.randrange(n_runs), rng.randrange(n_runs))}", i * 3 + 1, rng.choice(kinds),
         T0 + dt.timedelta(minutes=rng.randrange(12)))
        for i in range(n_events)
    ]


def step_through(rows):
    """One event after another, as a store with a row per run does it."""
    state, refused, history = {}, set(), []
    for run, arrival, kind, time in sorted(rows, key=lambda r: r[1]):
        if run not in state:
            state[run] = (kind, time)
            history.append((run, arrival, None, kind))
            continue
        old, top = state[run]
        if time > top and old != kind:
            if old in TERMINAL:
                refused.add(arrival)
                continue
            history.append((run, arrival, old, kind))
        if time > top:
            state[run] = (kind, time)
    return state, refused, history


@pytest.mark.parametrize("seed,width", [(1, 1 << 24), (2, 10), (3, 4)])
def test_refusal_and_history_across_blocks(spark, seed, width):
    rows = event_rows(seed, 12, 200)
    frame = spark.createDataFrame(rows, "run_id string, arrival long, event_type string, event_time timestamp").cache()
    state, refused, history = step_through(rows)
    got = {r.arrival for r in runs.refused_events(frame, width).collect()}
    assert got == refused
    accepted = runs.accept_events(frame, width)
    changes = runs.state_changes(accepted, width).collect()
    assert sorted((r.run_id, r.arrival, r.from_state, r.to_state) for r in changes) == sorted(
        history, key=lambda h: (h[0], h[1])
    )
    top = accepted.groupBy("run_id").agg(F.max_by("event_type", F.struct("event_time", -F.col("arrival"))).alias("s")).collect()
    assert {r.run_id: r.s for r in top} == {run: kind for run, (kind, _) in state.items()}


def test_rank_and_previous_across_blocks(spark):
    rows = [(i % 3 if i % 2 else None, i, chr(65 + i % 7)) for i in range(60)]
    frame = spark.createDataFrame(rows, "k long, i long, v string")
    block = F.floor(F.col("i") / 7)
    ranked = ordered.with_rank(frame, ["k"], ["i"], block, "n")
    previous = ordered.with_previous(frame, ["k"], ["i"], block, F.col("v"), "p")
    want_rank, want_previous, seen = {}, {}, {}
    for k, i, v in rows:
        earlier = seen.setdefault(k, [])
        want_rank[i], want_previous[i] = len(earlier) + 1, earlier[-1] if earlier else None
        earlier.append(v)
    assert {r.i: r.n for r in ranked.collect()} == want_rank
    assert {r.i: r.p for r in previous.collect()} == want_previous


def test_dedup_is_greedy_per_key(spark, scratch):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(4)}", i, T0 + dt.timedelta(hours=2 * i + rng.randrange(2))) for i in range(80)]
    frame = spark.createDataFrame(rows, "idempotency_key string, arrival long, ingested_at timestamp")
    last, want = {}, set()
    for key, arrival, time in rows:
        if key not in last or time >= last[key] + dt.timedelta(hours=24):
            last[key] = time
            want.add(arrival)
    assert {r.arrival for r in dedup.accepted_copies(frame, scratch).collect()} == want


def sequence(spark, scratch, kinds):
    rows = [(1, i, "r", kind, T0 + dt.timedelta(minutes=minute)) for i, (kind, minute) in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "batch_id long, arrival long, run_id string, event_type string, event_time timestamp")
    row = validation.sequence_errors(frame, scratch).collect()[0]
    return row.sequence_error, row.final_state


def test_sequences(spark, scratch):
    assert sequence(spark, scratch, [("COMPLETE", 2), ("START", 0), ("RUNNING", 1)]) == (None, "COMPLETE")
    assert sequence(spark, scratch, [("START", 0), ("START", 1)])[0] == "duplicate_start"
    assert sequence(spark, scratch, [("START", 0), ("RUNNING", 1), ("START", 2)])[0] == "backward_transition"
    assert sequence(spark, scratch, [("START", 0), ("COMPLETE", 1), ("FAIL", 130)])[0] == "terminal_state_immutable"
    assert sequence(spark, scratch, [("OTHER", 0), ("START", 1), ("OTHER", 200), ("COMPLETE", 300), ("OTHER", 400)]) == (None, "COMPLETE")
    assert sequence(spark, scratch, [("OTHER", 0), ("OTHER", 1)]) == (None, "OTHER")


def test_page_rules():
    assert validation.check_page() == {"limit": 20, "offset": 0, "status": "active", "window_days": None}
    assert validation.check_page(status="muted")["window_days"] == 7
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"status": "x"}, {"window_days": 91}):
        with pytest.raises(ValueError):
            validation.check_page(**bad)


def test_event_array_file(spark, scratch, tmp_path):
    record = {"eventTime": "2025-10-21T10:05:00Z", "eventType": " START ", "producer": "p", "schemaURL": SPEC,
              "run": {"runId": "r1", "facets": {"custom": {"deep": [1, 2]}}}, "job": {"namespace": "n", "name": "j"},
              "inputs": [{"namespace": "postgres://db:5432/my", "name": "t"}], "outputs": None}
    (tmp_path / "good.json").write_text(json.dumps([record, record], indent=1))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "broken.json").write_text("[{")
    (tmp_path / "object.json").write_text(json.dumps(record))
    events, refused = event_source.read_event_batch(spark, str(tmp_path), scratch)
    rows = event_source.normalize_events(events).collect()
    row = rows[0]
    assert len(rows) == 2 and len({r.arrival for r in rows}) == 2 and len({r.batch_id for r in rows}) == 1 and row.ingested_at
    assert (row.event_type, json.loads(row.run_facets["custom"]), row.outputs, row.job_facets) == ("START", {"deep": [1, 2]}, [], {})
    assert (row.inputs[0].namespace, row.inputs[0].name, row.inputs[0].urn) == ("postgresql://db", "my/t", "postgresql://db/my/t")
    reasons = {r.source_file.rsplit("/", 1)[1]: r.reason for r in refused.collect()}
    assert reasons == {"empty.json": "empty_event_array", "broken.json": "not_an_event_array", "object.json": "not_an_event_array"}
    none = spark.createDataFrame([], RESOLUTIONS)
    assert ingest(event_source.normalize_events(events), scratch, none).outcomes.count() == 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution_requests(spark, seed):
    rng = random.Random(seed)
    members = [(str(i), f"t{i % 2}", "d", None if i % 7 == 0 else f"root{i % 3}") for i in range(24)]
    old = {m[0]: rng.choice(["acknowledged", "resolved", "muted"]) for m in members if rng.random() < 0.3}
    asked = [(i, str(rng.randrange(26)), rng.choice(["acknowledged", "resolved", "muted"])) for i in range(40)]
    incidents = spark.createDataFrame(members, "test_result_id string, test_name string, dataset_urn string, test_root_parent_run_id string")
    table = spark.createDataFrame(
        [(k, v, "a", "", "", None, None, T0) for k, v in old.items()],
        RESOLUTIONS)
    requests = resolution.check_requests(spark.createDataFrame(
        [(s, t, status, "why", "", 5, "me", T0 + dt.timedelta(days=s)) for s, t, status in asked],
        "seq long, test_result_id string, status string, reason string, note string, mute_days int, resolved_by string, requested_at timestamp"))
    state, group = {m[0]: old.get(m[0], "open") for m in members}, {m[0]: m[1:] for m in members}
    outcomes = {}
    for seq, target, status in asked:
        allowed = ("open",) if status == "acknowledged" else ("open", "acknowledged")
        if target not in state:
            outcomes[seq] = "not_found"
        elif state[target] not in allowed:
            outcomes[seq] = "conflict"
        else:
            outcomes[seq] = "accepted"
            for other in state:
                same = group[other] == group[target] and group[target][2] is not None
                if (other == target or same) and state[other] in allowed:
                    state[other] = status
    got = {r.seq: r.outcome for r in resolution.request_outcomes(incidents, table, requests).collect()}
    assert got == outcomes
    after = {r.test_result_id: r.status for r in resolution.apply_requests(incidents, table, requests).collect()}
    assert after == {k: v for k, v in state.items() if v != "open"}


def message(arrival, run, kind, minute, hour=0, outputs=True, success=None):
    dataset = {"namespace": "postgres://wh:5432", "name": f"s.{run}", "facets": {"a": {"at": arrival}}}
    if success is not None:
        dataset["inputFacets"] = {"dataQualityAssertions": {"assertions": [{"assertion": "t", "success": success}]}}
    body = {"eventTime": (T0 + dt.timedelta(minutes=minute)).isoformat() + "Z", "eventType": kind,
            "producer": "https://github.com/a/b/tree/1.0", "schemaURL": SPEC, "run": {"runId": run},
            "job": {"namespace": "n", "name": "j"}, "inputs": [] if outputs else [dataset], "outputs": [dataset] if outputs else []}
    return (None, arrival, T0 + dt.timedelta(hours=hour), json.dumps(body))


def test_store_over_batches(spark, tmp_path):
    first = [message(1, "a", "START", 0), message(2, "b", "START", 0), (None, 3, T0, "{broken"),
             message(4, "c", "COMPLETE", 5, outputs=False, success=False)]
    second = [message(5, "a", "COMPLETE", 10, 1), message(6, "a", "START", 0, 1), message(7, "a", "RUNNING", 20, 1),
              message(8, "b", "RUNNING", 2, 3), message(9, "c2", "COMPLETE", 6, 30, outputs=False, success=True)]
    store = LineageStore(spark, str(tmp_path / "store"))
    schema = "batch_id long, arrival long, ingested_at timestamp, value string"

    def state():
        t = store.read()
        return {
            "runs": sorted((r.run_id, r.current_state, r.started_at, r.completed_at) for r in t.runs.collect()),
            "datasets": sorted((r.dataset_urn, r.facets.get("a", "")) for r in t.datasets.collect()),
            "tests": sorted((r.run_id, r.status) for r in t.tests.collect()),
            "rejected": sorted(r.arrival for r in store.tables["rejected"].read().collect()),
        }

    assert store.take(spark.createDataFrame(first, schema), 0)
    assert store.take(spark.createDataFrame(second, schema), 1)
    once = state()
    assert once["runs"] == [
        ("a", "COMPLETE", T0, T0 + dt.timedelta(minutes=10)), ("b", "RUNNING", T0, None),
        ("c", "COMPLETE", T0 + dt.timedelta(minutes=5), T0 + dt.timedelta(minutes=5)),
        ("c2", "COMPLETE", T0 + dt.timedelta(minutes=6), T0 + dt.timedelta(minutes=6)),
    ]
    assert once["datasets"][0] == ("postgresql://wh/s.a", '{"at":5}')
    assert once["tests"] == [("c", "failed"), ("c2", "passed")]
    assert once["rejected"] == [7]
    assert not store.take(spark.createDataFrame(second, schema), 1)
    assert state() == once
    assert sorted(tuple(r) for r in store.ledger.read().collect()) == [(4, 1, 0, 0), (5, 0, 0, 1)]


def test_keyed_table(spark, scratch, tmp_path):
    rows = spark.range(20).selectExpr("id", "'old' AS v")
    table = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["id"], rows_per_bucket=5)
    assert table.read().count() == 0
    table.upsert(rows, scratch)
    table.upsert(spark.range(5).selectExpr("id", "'new' AS v"), scratch)
    table.insert_missing(spark.range(18, 22).selectExpr("id", "'late' AS v"), scratch)
    got = {r.id: r.v for r in table.read().collect()}
    assert got == {**{i: "old" for i in range(20)}, **{i: "new" for i in range(5)}, 20: "late", 21: "late"}


def test_interleaved_batches_trade_their_own_places(spark, scratch):
    def row(batch, arrival, run, kind, minute):
        return (batch, arrival, run, kind, T0 + dt.timedelta(minutes=minute), "p", SPEC, "n", "j")

    rows = [row(1, 10, "a", "COMPLETE", 5), row(2, 11, "b", "COMPLETE", 9), row(1, 12, "a", "START", 0), row(2, 13, "b", "START", 1)]
    frame = spark.createDataFrame(rows, "batch_id long, arrival long, run_id string, event_type string, event_time timestamp, "
                                  "producer string, schema_url string, job_namespace string, job_name string")
    got = {r.message: (r.run_id, r.event_type, r.arrival) for r in validation.validate_batches(frame, scratch).collect()}
    assert got == {10: ("a", "COMPLETE", 12), 12: ("a", "START", 10), 11: ("b", "COMPLETE", 13), 13: ("b", "START", 11)}


def test_rows_close_in_time_span_several_ranges(spark, scratch):
    rows = [("k", T0 + dt.timedelta(seconds=i), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, t timestamp, i long").repartition(3)
    ranged = ordered.range_blocks(frame, ["k"], ["t", "i"], scratch)
    assert ranged.select(ordered.RANGE).distinct().count() > 1
    ranked = ordered.with_rank(ranged, ["k"], ["t", "i"], F.col(ordered.RANGE), "n")
    assert {r.i: r.n for r in ranked.collect()} == {i: i + 1 for i in range(400)}


def test_replay_of_a_refused_event(spark, tmp_path):
    """COMPLETE, a refused FAIL, COMPLETE: done again, the batch changes nothing."""
    batch = spark.createDataFrame(
        [message(1, "a", "COMPLETE", 2), message(2, "a", "FAIL", 3), message(3, "a", "COMPLETE", 5)],
        "batch_id long, arrival long, ingested_at timestamp, value string")
    store = LineageStore(spark, str(tmp_path / "store"))

    def apply():
        scratch = Scratch(spark)
        store._apply(scratch.cut(stream_ingest.counted(batch)[0]), 0, scratch)

    apply()

    def state():
        found = {name: sorted(map(str, store.tables[name].read().collect())) for name in store.tables}
        return {**found, "keys": sorted(map(str, store.keys.read().collect()))}

    once = state()
    assert len(once["rejected"]) == 1 and len(once["runs"]) == 1
    apply()  # as after a failure before the batch was in the ledger
    assert state() == once
    history = [(r.arrival, r.from_state, r.to_state) for r in store.tables["history"].read().collect()]
    assert history == [(1, None, "COMPLETE")]


def test_requests_on_stored_resolutions_and_expiry_of_keys(spark, tmp_path):
    store = LineageStore(spark, str(tmp_path / "store"))
    schema = "batch_id long, arrival long, ingested_at timestamp, value string"
    store.take(spark.createDataFrame([message(1, "m", "COMPLETE", 0), message(2, "m", "COMPLETE", 1, outputs=False, success=False)], schema), 0)
    assert store.keys.read().count() == 2
    failed = store.read().tests.first().test_result_id
    asked = spark.createDataFrame(
        [(1, failed, "acknowledged", "", "", 0, "me", T0), (2, failed, "muted", "known", "", 5, "me", T0)],
        "seq long, test_result_id string, status string, reason string, note string, mute_days int, resolved_by string, requested_at timestamp")
    store.apply_requests(asked)
    found = store.read().resolutions.collect()
    assert [(r.test_result_id, r.status, r.mute_expires_at) for r in found] == [(failed, "muted", T0 + dt.timedelta(days=5))]
    store.take(spark.createDataFrame([message(3, "z", "START", 0, hour=49)], schema), 1)
    assert store.keys.read().count() == 3
    days = store.expire_keys(T0 + dt.timedelta(hours=49))
    assert days == [(T0 + dt.timedelta(hours=24)).date()] and [r.arrival for r in store.keys.read().collect()] == [3]
    assert store.expire_keys(T0 + dt.timedelta(hours=49)) == []


def test_stream_keeps_a_copy_after_a_day(spark, tmp_path):
    """One file per micro-batch, and the stream started anew in between; the time to live counts from the copy that was kept."""
    schema = "arrival long, idempotency_key string, ingested_at timestamp, note string"
    hours = [0, 5, 23, 25, 48, 50]
    for start in (0, 3):
        for i in range(start, start + 3):
            rows = [(i * 2, "k", T0 + dt.timedelta(hours=hours[i]), "n"), (i * 2 + 1, f"own{i}", T0, None), (100 + i, "k", T0 + dt.timedelta(hours=hours[i]), "late")]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_dedup(stream, str(tmp_path / "out"), str(tmp_path / "progress"), available_now=True).awaitTermination()
    kept = {r.arrival: (r.ingested_at, r.note) for r in spark.read.parquet(str(tmp_path / "out" / "events")).collect()}
    assert set(kept) == {0, 6, 10, *range(1, 12, 2)} and kept[6] == (T0 + dt.timedelta(hours=25), "n")


def test_expiry_reads_no_live_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", T0 + dt.timedelta(hours=i)) for i in range(0, 120, 7)], "idempotency_key string, expires_at timestamp")
    keys = ExpiringKeys(spark, str(tmp_path / "keys"), rows.schema)
    keys.write(rows, 1)
    keys.write(rows.filter("idempotency_key < 'k3'"), 1)  # the batch again: only the partitions that it has are replaced
    as_of = T0 + dt.timedelta(days=3, hours=5)
    plan = keys.expired(as_of)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "expires_in" in plan.split("PartitionFilters")[1].split("]")[0]
    before = {f for f in spark.read.parquet(str(tmp_path / "keys")).inputFiles()}
    assert len(keys.expire(as_of)) == 3
    after = {f for f in spark.read.parquet(str(tmp_path / "keys")).inputFiles()}
    assert after < before and all(r.expires_at.date() >= as_of.date() for r in keys.read().collect())
    assert sorted(r.expires_at for r in keys.alive(as_of).collect()) == [r for r in sorted(r.expires_at for r in keys.read().collect()) if r >= as_of]


def test_refresh_by_change_equals_a_rebuild(spark, tmp_path):
    """Three batches; the reports equal a rebuild, and buckets without a change are not written."""
    def linked(arrival, run, reads, writes, minute, kind="COMPLETE", success=None, parent=None):
        dataset = lambda name: {"namespace": "ns", "name": name}
        inputs = [dataset(d) for d in reads]
        if success is not None:
            inputs[0]["inputFacets"] = {"dataQualityAssertions": {"assertions": [{"assertion": "t", "success": success}]}}
        facets = {"parent": {"run": {"runId": parent}, "root": {"run": {"runId": parent}}}} if parent else {}
        body = {"eventTime": (T0 + dt.timedelta(minutes=minute)).isoformat() + "Z", "eventType": kind, "producer": "https://github.com/a/b/tree/1.0",
                "schemaURL": SPEC, "run": {"runId": run, "facets": facets}, "job": {"namespace": "n", "name": "j"}, "inputs": inputs,
                "outputs": [dataset(d) for d in writes]}
        return (None, arrival, T0 + dt.timedelta(minutes=minute), json.dumps(body))

    batches = [
        [linked(i, f"r{i}", [f"d{i // 2}"] if i else [], [f"d{i}"], i, "START", parent="root") for i in range(30)]
        + [linked(100 + i, f"q{i}", [f"d{i * 3}"], [], i, success=False) for i in range(8)],
        [linked(200, "new", ["d29"], ["leaf"], 50), linked(201, "root", [], [], 51), linked(202, "q9", ["leaf"], [], 52, success=False)],
        [linked(300, "r3", ["d1"], ["d3"], 60), linked(301, "q1", ["d3"], [], 61, success=True)],
    ]
    store = LineageStore(spark, str(tmp_path / "store"), rows_per_bucket=8)
    schema = "batch_id long, arrival long, ingested_at timestamp, value string"

    def shown():
        return {n: sorted(map(str, store.reports.read(n).collect())) for n in ("resolved_datasets", "incident_view", "impact")}

    def files(name):
        return set(spark.read.parquet(f"{store.root}/reports/{name}").inputFiles())

    for number, batch in enumerate(batches):
        before = {n: files(n) for n in ("resolved_datasets", "impact")} if number else None
        assert store.take(spark.createDataFrame(batch, schema), number, refresh=True)
        if number == 2:
            assert all(before[n] & files(n) and before[n] - files(n) for n in before)
        by_change = shown()
        store.rebuild()
        assert by_change == shown() and all(by_change.values())


def test_a_write_that_fails_changes_nothing(spark, scratch, tmp_path):
    rows = spark.range(20).selectExpr("id", "'old' AS v")
    table = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["id"], rows_per_bucket=5)
    table.upsert(rows, scratch)
    broken = spark.range(20).selectExpr("id", "CASE WHEN id = 19 THEN raise_error('stop') ELSE 'new' END AS v")
    with pytest.raises(Exception):
        table.merge(rows, lambda old, new: broken, scratch)
    assert {r.v for r in table.read().collect()} == {"old"} and table.read().count() == 20


def test_a_key_that_comes_back_every_day_for_three_years(spark, scratch):
    """Links are followed in doubled jumps: at most twelve rounds, however many days."""
    rng = random.Random(5)
    hours = [24 * day for day in range(1096)] + [24 * day + 5 for day in range(0, 1096, 3)]
    rows = [("daily", i, T0 + dt.timedelta(hours=h)) for i, h in enumerate(hours)]
    for key in ("a", "b", "c"):
        rows += [(key, 10_000 + len(rows) + i, T0 + dt.timedelta(minutes=rng.randrange(20_000))) for i in range(60)]
    rows += [("same", 90_000 + i, T0) for i in range(5)] + [("same", 99_000, T0 + dt.timedelta(hours=24))]
    kept, last = set(), {}
    for key, arrival, time in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or time >= last[key] + dt.timedelta(hours=24):
            kept.add(arrival)
            last[key] = time
    rounds = []
    counted = Scratch(spark)
    followed, dedup._followed = dedup._followed, lambda *args: rounds.append(counted._count) or followed(*args)
    try:
        frame = spark.createDataFrame(rows, "idempotency_key string, arrival long, ingested_at timestamp")
        got = {r.arrival for r in dedup.accepted_copies(frame, counted).collect()}
    finally:
        dedup._followed = followed
    assert got == kept and len([a for a in kept if a < 1096]) == 1096
    assert (counted._count - rounds[0]) / 3 <= 12  # a round writes three tables
    counted.drop()


def test_ingest_settles_outcomes_over_single_fields(spark, scratch, tmp_path):
    """Facets and datasets are in no table that is written on the way, and what is stored has them all the same."""
    def record(run, kind, minute):
        return {"eventTime": f"2025-10-21T10:{minute:02d}:00Z", "eventType": kind, "producer": "p", "schemaURL": SPEC,
                "run": {"runId": run, "facets": {"big": {"text": "x" * 50}}}, "job": {"namespace": "n", "name": "j"},
                "inputs": [{"namespace": "a://b", "name": "in", "facets": {"f": {"v": minute}}}], "outputs": [{"namespace": "a://b", "name": run}]}

    (tmp_path / "one.json").write_text(json.dumps([record("r1", "COMPLETE", 5), record("r1", "START", 1)]))
    (tmp_path / "two.json").write_text(json.dumps([record("r2", "START", 1), record("r3", "FAIL", 2), record("r2", "START", 1)]))
    events, _ = event_source.read_event_batch(spark, str(tmp_path), scratch)
    events = scratch.cut(event_source.normalize_events(events))
    own = Scratch(spark)
    done = ingest(events, own, spark.createDataFrame([], RESOLUTIONS))
    assert sorted(r.outcome for r in done.outcomes.collect()) == ["duplicate"] + ["stored"] * 4
    assert done.stored.count() == 4 and done.stored.filter("size(inputs) = 1 AND run_facets['big'] IS NOT NULL").count() == 4
    assert {(r.run_id, r.event_type): r.arrival for r in done.heads.filter("run_id = 'r1'").collect()} == {
        (r.run_id, r.event_type): r.arrival for r in done.stored.filter("run_id = 'r1'").collect()}
    assert {(r.run_id, r.current_state) for r in done.tables.runs.collect()} == {("r1", "COMPLETE"), ("r2", "START"), ("r3", "FAIL")}
    assert done.tables.edges.count() == 6 and done.tables.datasets.count() == 4
    for number in range(own._count):
        assert not {"inputs", "outputs", "run_facets", "job_facets"} & set(spark.read.parquet(f"{own.root}/{number}").columns)
    own.drop()


def test_sequences_at_once_and_in_ranges(spark, scratch):
    rng = random.Random(3)
    kinds = ["START", "RUNNING", "COMPLETE", "FAIL", "OTHER", "bad"]
    rows = []
    for i in range(400):
        batch = None if i % 29 == 0 else i % 23
        run = f"r{i % 2}" if batch in (3, 4) else f"r{batch}"
        time = None if i % 31 == 0 else T0 + dt.timedelta(minutes=rng.randrange(40))
        kind = "START" if batch == 7 else rng.choice(kinds)
        rows.append((batch, 1000 - i, run, kind, time, "p", SPEC, "n", "j"))
    frame = spark.createDataFrame(rows, "batch_id long, arrival long, run_id string, event_type string, event_time timestamp, "
                                  "producer string, schema_url string, job_namespace string, job_name string").repartition(3)
    found = []
    for limit in (validation.WINDOW_EVENTS, 17, 1):
        got = validation.validate_batches(frame, scratch, window_events=limit)
        found.append({r.message: (r.arrival, r.run_id, r.event_type, r.batch_id, r.reject_reason) for r in got.collect()})
    assert len(found[0]) == 400 == len({v[0] for v in found[0].values()}) and found[0] == found[1] == found[2]
    assert any(v[4] == "invalid_sequence:duplicate_start" for v in found[0].values())
    groups = {}
    for batch, arrival, run, _, time, *_ in rows:
        groups.setdefault(batch, []).append((time or dt.datetime(1, 1, 1), arrival, run))
    for batch, events in groups.items():
        one = batch is not None and len({e[2] for e in events}) == 1
        places = sorted(e[1] for e in events) if one else [e[1] for e in sorted(events, key=lambda e: e[:2])]
        for event, place in zip(sorted(events, key=lambda e: e[:2]), places):
            assert found[0][event[1]][0] == place


def test_single_fields_are_read_as_with_the_whole_event(spark):
    """Facets and datasets of any shape change none of the single fields, and are not asked for."""
    good = {"eventTime": "2025-10-21T10:05:00+00:00", "eventType": " START ", "producer": "p", "schemaURL": SPEC,
            "run": {"runId": "r1", "facets": {"f": {"deep": [1]}}}, "job": {"namespace": "n", "name": "j", "facets": {}}}
    values = [json.dumps({**good, "inputs": [{"namespace": "a://b", "name": "t", "facets": {"x": "\\"}}], "outputs": None})]
    values += [json.dumps({**good, **odd}) for odd in (
        {"inputs": "none"}, {"inputs": [5, {"name": 7}], "outputs": {}}, {"run": {"facets": [], "runId": "r2"}}, {"run": "r3"},
        {"job": {"name": {"a": 1}, "facets": 5, "namespace": "n"}}, {"eventTime": 5}, {"eventType": None}, {"eventTime": "2025-10-21T9:05:00,50"})]
    values += [values[0][:90], "[]", "", "null"]
    frame = spark.createDataFrame([(1, i, T0, value) for i, value in enumerate(values)], "batch_id long, arrival long, ingested_at timestamp, value string")
    heads = event_source.read_heads(frame)
    assert "inputs" not in heads.columns and "run_facets" not in heads.columns
    whole = event_source.read_messages(frame).select(*heads.columns)
    assert sorted(map(str, heads.collect())) == sorted(map(str, whole.collect())) and heads.count() == 8


def test_times_of_whole_seconds(spark):
    texts = ["2025-10-21T10:05:00", "2025-10-21T10:05:00Z", "2025-10-21T10:05:00-00:00", " 2025-10-21T10:05:00+00:00", "2025-10-21T10:05:00+02:00",
             "2025-10-21T9:05:00", "2025-10-21T10:05:00.250+02:00", "2025-10-21T10:05:00.0", "2025-10-21T10:05:00+0200", "2025-10-21 10:05:00"]
    want = ["2025-10-21T10:05:00Z"] * 4 + ["2025-10-21T10:05:00+02:00", "2025-10-21T09:05:00Z", "2025-10-21T10:05:00.25+02:00", "2025-10-21T10:05:00Z", None, None]
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i long, t string")
    got = {r.i: r.v for r in frame.select("i", ef.event_time_text(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_keys_go_through_no_table_of_all_events(spark, scratch):
    """Of the tables that the ingest writes on the way only the first, and that of events with a mark in common, hold keys."""
    rows = [(1 if i % 3 else None, 10 * i, f"r{i % 40}", "START" if i < 40 else "OTHER", T0 + dt.timedelta(minutes=i % 40), T0 + dt.timedelta(hours=i // 40),
             "p", SPEC, "n", "j", f"{i % 95:064x}") for i in range(100)]
    heads = spark.createDataFrame(rows, "batch_id long, arrival long, run_id string, event_type string, event_time timestamp, ingested_at timestamp, "
                                  "producer string, schema_url string, job_namespace string, job_name string, idempotency_key string")
    own = Scratch(spark)
    done = settle(heads, own)
    assert {r.arrival for r in done.outcomes.filter("outcome = 'duplicate'").collect()} == {10 * i for i in range(95, 100)}
    keys = {r.arrival: r.idempotency_key for r in done.keyed(done.copies).select(key_text(), "arrival").collect()}
    assert keys == {10 * i: f"{i:064x}" for i in range(95)}
    holding = [spark.read.parquet(f"{own.root}/{n}") for n in range(own._count)]
    counts = [frame.count() for frame in holding if "idempotency_key" in frame.columns]
    assert counts[0] == 100 and max(counts[1:]) == 10
    own.drop()


def test_request_files_are_written_compressed(spark):
    """Files of one array each are read whole, so they may be compressed, and a1 writes its own that way."""
    given = Given(spark, "/root/testdata/sf0.001")
    events = read_batches(given)
    files = [f for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{given.scratch.root}/requests").select("path", "length").collect()
             if "part=-" not in f.path]
    assert files and all(f.path.endswith(".gz") for f in files)
    assert events.count() == event_source.keep_run_events(given["messages"]).count()


def test_a_key_asks_for_its_state_once(spark):
    class State:
        def __init__(self, value):
            self.value, self.calls = value, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    def keep(value, *parts):
        processor = KeepOnce(100, None)
        processor.kept = State(value)
        frames = [pd.DataFrame(part, columns=["arrival", "ingested_at"]) for part in parts]
        kept = [row for frame in processor.handleInputRows(("k",), iter(frames), None) for row in frame["arrival"].tolist()]
        return kept, processor.kept.value, processor.kept.calls

    assert keep(None, [(1, 5)]) == ([1], (5,), ["get", "update"])
    assert keep((5,), [(2, 104)]) == ([], (5,), ["get"])
    assert keep((5,), [(2, 105)]) == ([2], (105,), ["get", "update"])
    assert keep(None, [(3, 250), (1, 5)], [(2, 104), (4, 105)]) == ([1, 4, 3], (250,), ["get", "update"])


def test_refusal_shuffles_all_events_once(spark, scratch):
    rows = [(f"r{i % 3}", 10 * i + j, kind, T0 + dt.timedelta(minutes=i + j))
            for i in range(30) for j, kind in enumerate(("START", "COMPLETE", "FAIL"))]
    events = scratch.cut(spark.createDataFrame(rows, "run_id string, arrival bigint, event_type string, event_time timestamp"))
    refused = runs.refused_events(events, scratch=scratch)
    # All steps after the first read the written events of followed runs, not those of all.
    assert not set(events.inputFiles()) & set(refused.inputFiles())
    assert sorted(refused.collect()) == sorted(runs.refused_events(events).collect()) != []


class Recorded(Scratch):
    """Keeps the columns of every table that is written."""

    def __init__(self, spark):
        super().__init__(spark)
        self.written = []

    def cut(self, df):
        self.written.append(df.columns)
        return super().cut(df)


def test_a_batch_is_settled_over_single_fields(spark, tmp_path):
    """Datasets of events are written as they are read and as they are stored, not in between; changes only for a refresh."""
    batch = spark.createDataFrame(
        [message(1, "a", "START", 0), message(2, "a", "COMPLETE", 5), message(3, "a", "FAIL", 9), message(4, "a", "START", 0)],
        "batch_id long, arrival long, ingested_at timestamp, value string")
    store, scratch = LineageStore(spark, str(tmp_path / "store")), Recorded(spark)
    store._apply(scratch.cut(stream_ingest.counted(batch)[0]), 0, scratch)
    assert sum("inputs" in columns for columns in scratch.written) == 2
    assert ["run_id"] not in scratch.written
    assert [r.arrival for r in store.tables["rejected"].read().collect()] == [3]
    assert sorted(r.arrival for r in store.keys.read().collect()) == [1, 2]


def test_a_run_that_writes_nothing_touches_no_origin_above(spark, scratch, tmp_path):
    """A check that reads a dataset makes no path new, so the runs above it keep their impact."""
    store = LineageStore(spark, str(tmp_path / "store"))
    schema = "batch_id long, arrival long, ingested_at timestamp, value string"
    check = message(3, "c", "COMPLETE", 5, outputs=False, success=True)
    check = (*check[:3], check[3].replace('"s.c"', '"s.a"'))
    assert store.take(spark.createDataFrame([message(1, "a", "START", 0), message(2, "a", "COMPLETE", 2), check], schema), 0)
    read = {r.dataset_urn for r in store.read().edges.collect() if r.run_id == "c"}
    assert read & {r.dataset_urn for r in store.read().edges.collect() if r.run_id == "a" and r.edge_type == "output"}

    def touched(batch):
        checked = scratch.cut(stream_ingest.counted(spark.createDataFrame([batch], schema))[0])
        return sorted(r.run_id for r in reports.touched_origins(store.read(), stream_ingest.changes(checked, scratch), scratch).collect())

    assert touched(check) == ["c"]
    assert "a" in touched(message(2, "a", "COMPLETE", 2))


def _asserting(key, run, test="t"):
    return ('{"eventTime":"2024-01-01T00:00:00Z","eventType":"COMPLETE","producer":"p","schemaURL":"' + SPEC + '","run":{"runId":"' + run
            + '"},"job":{"namespace":"n","name":"j"},"inputs":[{"namespace":"a://b","name":"t","inputFacets":{"' + key
            + '":{"assertions":[{"assertion":"' + test + '","success":true}]}}}],"outputs":[]}')


def test_messages_without_assertions_are_not_parsed_for_tests(spark):
    """A key may be written with escapes, so only a text without a backslash is told by its letters."""
    values = [_asserting("dataQualityAssertions", "plain"), _asserting(r"data\u0051ualityAssertions", "escaped"),
              _asserting("otherFacet", "other"), _asserting("otherFacet", "slash", r"\"t"), "dataQualityAssertions", None]
    messages = spark.createDataFrame([(1, n, T0, v) for n, v in enumerate(values)],
                                     "batch_id long, arrival long, ingested_at timestamp, value string")
    left = messages.filter(tables.may_hold_tests(F.col("value")))
    assert {r.arrival for r in left.collect()} == {0, 1, 3, 4}
    found = tables.extract_tests(event_source.read_messages(left)).collect()
    assert sorted((r.run_id, r.test_name) for r in found) == [("escaped", "t"), ("plain", "t")]
    assert sorted(r.run_id for r in tables.extract_tests(event_source.read_messages(messages)).collect()) == ["escaped", "plain"]


@pytest.mark.parametrize("made", [tables.mentions, tables.slim_mentions, tables.extract_tests, tables.facet_entries])
def test_events_are_parsed_once_for_what_is_taken_out(spark, scratch, made):
    """Spark asks of an array that is exploded whether it is empty before it parses the message, and so parses it twice."""
    messages = scratch.cut(spark.createDataFrame([(1, 1, T0, _asserting("dataQualityAssertions", "r"))],
                                                 "batch_id long, arrival long, ingested_at timestamp, value string"))
    rows = made(event_source.read_messages(messages))
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    assert rows.count() == (0 if made is tables.facet_entries else 1)  # what a check reads has no facets written


def test_a_table_has_a_bounded_number_of_buckets(spark, scratch, tmp_path, monkeypatch):
    """Its rows stay whole, whatever is asked of it, also when all of its buckets are touched."""
    monkeypatch.setattr(table_store, "MAX_BUCKETS", 4, raising=False)
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table = KeyedTable(spark, str(tmp_path / "table"), rows.schema, ["k"], rows_per_bucket=10)
    table.insert_missing(rows.filter("k < 30"), scratch)
    table.upsert(rows, scratch)
    table.upsert(rows.filter("k % 2 = 0").withColumn("v", F.lit(-1).cast("bigint")), scratch)
    table.replace(rows.filter("k % 50 = 1"), rows.filter("k % 100 = 1"), scratch)
    want = {k: -1 if k % 2 == 0 else 2 * k for k in range(1000) if k % 50 != 1 or k % 100 == 1}
    got = table.read().collect()
    assert len(got) == len(want) and {r.k: r.v for r in got} == want
    assert table._buckets() == 4
