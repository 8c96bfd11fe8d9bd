from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wrenfield.operators.snapshots import snapshot_changes, squeezed

ROW = "run_id bigint, delivered_at timestamp, job_id string, status string, change string, idx int"


def plain(rows, runs):
    held = {}
    for run, at, job, status, *_ in rows:
        if run is not None and job is not None:
            held.setdefault((run, job), []).append((at, status.replace(" ", "").lower() if status is not None else None))
    state = {k: max(v, key=lambda x: x[0])[1] for k, v in held.items()}
    runs, out = sorted(runs | {r for r, _ in state}), set()
    for a, b in zip(runs, runs[1:]):
        old, new = {j: s for (r, j), s in state.items() if r == a}, {j: s for (r, j), s in state.items() if r == b}
        out |= {(b, j, "added") for j in new.keys() - old.keys()} | {(b, j, "removed") for j in old.keys() - new.keys()} | {(b, j, "changed") for j in old.keys() & new.keys() if old[j] != new[j]}
    return out


def changes(spark, rows, runs):
    from datetime import datetime, timedelta

    data = [(r, datetime(2025, 1, 1) + timedelta(minutes=at), j, s, "x", 1) for r, at, j, s in rows]
    df = spark.createDataFrame(data, ROW)
    calendar = spark.createDataFrame([(r,) for r in runs], "id bigint")
    return {(r.run_id, r.job_id, r.change) for r in snapshot_changes(df, [squeezed(F.col("status"))], runs=calendar).collect()}


def test_gaps_repeats_nulls_and_late_rows(spark):
    rows = [(1, 0, "a", "open"), (1, 5, "a", " OPEN "), (1, 0, "b", "open"), (2, 1, "a", None), (3, 2, "a", None), (3, 2, "b", "open"), (None, 1, "c", "open"), (2, 1, None, "open"), (1, 9, "b", "stale")]
    assert changes(spark, rows, {1, 2, 3, 4}) == plain(rows, {1, 2, 3, 4})
    assert changes(spark, [], {1, 2}) == set()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(1, 4), st.sampled_from("abc")), st.sampled_from(["open", "Open ", "stale", "closed"]), max_size=12))
def test_against_plain_version(spark, table):
    rows = [(run, 0, job, status) for (run, job), status in table.items()]
    assert changes(spark, rows, {1, 2, 3, 4}) == plain(rows, {1, 2, 3, 4})
