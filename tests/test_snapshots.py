"""Snapshots compared by digests: the same findings as a join of all rows, and unchanged ranges left unread."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import access, audit, snapshots

SCHEMA = "id string, status string, a string, b string, tags array<string>, at timestamp, score float"


def rows(n, seed=0):
    rng = random.Random(seed)
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    return [
        [f"k{i}", "new", rng.choice([None, "x", "y"]), rng.choice([None, "x", "y"]), rng.choice([None, [], ["p", None], [None, "p"]]),
         start + datetime.timedelta(hours=i, microseconds=i), rng.choice([None, float("nan"), 0.5])]
        for i in range(n)
    ]


def stored(spark, tmp_path, name, data, **how):
    root = f"{tmp_path}/{name}"
    df = spark.createDataFrame([tuple(r) for r in data], SCHEMA)
    snapshots.write(df, root, "id", ["status"], **how)
    return df, root


def found(df):
    return sorted((r.id, r.change, tuple(sorted(r.columns))) for r in df.collect())


@pytest.mark.parametrize("timed", [False, True])
def test_findings_equal_the_join_of_all_rows(spark, tmp_path, timed):
    how = {"position": snapshots.timed_position("at"), "layout": snapshots.TIMED} if timed else {}
    layout = snapshots.TIMED if timed else snapshots.HASHED
    data = rows(400)
    later = [list(r) for r in data]
    later[3][1] = "sent"  # may change
    later[5][2], later[5][3] = "moved", None
    data[6][2], data[6][3] = None, "x"
    later[6][2], later[6][3] = "x", None  # the same values in other columns
    data[7][4], later[7][4] = ["p", None], [None, "p"]
    later[8][5] += datetime.timedelta(microseconds=1)
    later[9][5] += datetime.timedelta(days=300)  # to a range that only the later snapshot has
    later = [r for i, r in enumerate(later) if i not in (20, 21)] + rows(430, 1)[400:]
    b, before = stored(spark, tmp_path, "before", data, **how)
    a, after = stored(spark, tmp_path, "after", later, **how)
    want = found(audit.immutability(b, a, "t", "id", ["status"]))
    assert [w[0] for w in want] == ["k20", "k21", "k5", "k6", "k7", "k8", "k9"]
    assert found(snapshots.immutability(spark, before, after, "t", "id", ["status"], layout)) == want


def test_unchanged_folders_are_not_read(spark, tmp_path):
    data = rows(2000)
    later = [list(r) for r in data]
    later[1000][2] = "changed"
    later += rows(2100, 2)[2000:]
    how = {"position": snapshots.timed_position("at"), "layout": snapshots.TIMED}
    _, before = stored(spark, tmp_path, "before", data, **how)
    _, after = stored(spark, tmp_path, "after", later, **how)
    ranges = snapshots.differing_ranges(spark, before, after, snapshots.TIMED)
    folders = snapshots.folders_of(ranges, snapshots.TIMED)
    read = spark.read.parquet(f"{before}/rows").where(F.col("_folder").isin(folders))
    # 18 hours of rows around the changed one, and those of the folder that the last one shares with new rows.
    assert 1 <= read.count() <= 2 * 19
    some, other = snapshots.differing_rows(spark, before, after, snapshots.TIMED)
    assert some.count() <= 4 and other.count() <= 4 + 101
    assert found(snapshots.immutability(spark, before, after, "t", "id", ["status"], snapshots.TIMED)) == [("k1000", "mutated", ("a",))]


def test_equal_snapshots_and_empty_ones(spark, tmp_path):
    data = rows(50)
    _, one = stored(spark, tmp_path, "one", data)
    _, two = stored(spark, tmp_path, "two", [[r[0], "other", *r[2:]] for r in reversed(data)])
    assert snapshots.differing_ranges(spark, one, two).count() == 0
    assert found(snapshots.immutability(spark, one, two, "t", "id", ["status"])) == []
    _, none = stored(spark, tmp_path, "none", [])
    assert found(snapshots.immutability(spark, none, one, "t", "id", ["status"])) == []
    assert found(snapshots.immutability(spark, one, none, "t", "id", ["status"])) == sorted((r[0], "deleted", ()) for r in data)
    levels = {p.name for p in Path(f"{one}/digests").iterdir() if p.is_dir()}
    assert levels == {f"bits={b}" for b in snapshots.HASHED.steps}


def test_owners_meet_their_rows_and_admins_all_in_parts(spark):
    rng = random.Random(4)
    people = [(rng.choice("ab"), f"u{i}", rng.choice([None, False, False, True])) for i in range(30)]
    events = [(rng.choice("abc"), rng.choice([None, "u1", "u2", "u7", "u9"]), rng.choice(["admins", "owner_or_admins"]), i) for i in range(300)]
    e = spark.createDataFrame(events, "tenant_id string, owner_subject string, audience string, n int").repartition(3)
    p = spark.createDataFrame(people, "tenant_id string, subject string, is_tenant_admin boolean")
    seen = access.event_audience(e, p)
    want = sorted((s, n) for t, o, a, n in events for u, s, admin in people if t == u and (admin or (a == "owner_or_admins" and o == s)))
    assert seen.columns == ["subject", *e.columns] and sorted((r.subject, r.n) for r in seen.collect()) == want
    rows_seen = access.visible_rows(e.drop("audience"), p)
    assert sorted((r.subject, r.n) for r in rows_seen.collect()) == sorted((s, n) for t, o, a, n in events for u, s, admin in people if t == u and (admin or o == s))
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all("_part" in line or "_subject" in line for line in joins)
