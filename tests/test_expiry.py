"""Versions and stages that expire, and what is counted while tables are written."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyboard import session
from tallyboard.operators import integrity
from tallyboard.plans import refresh
from tallyboard.session import materialise, measure
from tallyboard.sources import expiry, snapshots

LATER = time.time() + 10 * 86_400


def publish(spark, root, name, n=3):
    return snapshots.publish_snapshot({"numbers": spark.range(n)}, root, name)


def versions(root):
    return sorted(p.name.removeprefix("snapshot=") for p in Path(root).glob("snapshot=*"))


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path)
    for name in "abcd":
        publish(spark, root, name)
    assert expiry.expire(spark, root, keep=2) == []  # replaced just now
    assert expiry.expire(spark, root, keep=2, now=LATER) == ["b", "a"]
    assert versions(root) == ["c", "d"]
    assert sorted(p.name for p in (tmp_path / "catalogue").iterdir() if p.is_dir()) == ["c", "d"]
    assert list((tmp_path / "expired").glob("[a-z]*")) == []
    assert snapshots.read_latest(spark, root)["numbers"].count() == 3
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, root, "a")
    assert publish(spark, root, "e", 5) == "e"
    assert snapshots.latest_version(spark, root) == "e"


def test_a_held_version_stays(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, "a", 7)
    with expiry.holding(spark, root) as tables:
        for name in "bcd":
            publish(spark, root, name)
        # all but the newest are old, and a hold taken now is not
        for entry in snapshots._catalogue(spark, root).collect():
            assert entry["published_at"] / 1e6 < time.time()
        soon = time.time() + 0.5
        time.sleep(0.6)
        hold = next((tmp_path / "holds" / "a").glob("[0-9a-f]*"))
        hold.touch()
        assert expiry.expire(spark, root, keep=1, lease=0.0, now=soon) == ["c", "b"]
        assert tables["numbers"].count() == 7
    assert expiry.expire(spark, root, keep=1, now=LATER) == ["a"]
    assert versions(root) == ["d"]


def test_an_expired_version_cannot_be_held(spark, tmp_path):
    root = str(tmp_path)
    for name in "ab":
        publish(spark, root, name)
    expiry._Store(spark, root).create("expired/a")
    with pytest.raises(ValueError), expiry.holding(spark, root, "a"):
        pass
    assert [p for p in (tmp_path / "holds").rglob("*") if p.is_file() and p.suffix != ".crc"] == []
    with expiry.holding(spark, root) as tables:
        assert tables["numbers"].count() == 3
    # a run that ended after its mark is taken up again
    assert expiry.expire(spark, root, keep=1, now=LATER) == ["a"]


def test_left_overs_of_dead_publishers(spark, tmp_path):
    root = str(tmp_path)
    assert expiry.expire(spark, root) == []
    for name in "ab":
        publish(spark, root, name)
    spark.range(2).write.parquet(f"{root}/snapshot=dead/numbers")
    expiry.expire(spark, root)
    assert "dead" in versions(root)
    expiry.expire(spark, root, now=LATER)
    assert versions(root) == ["a", "b"]
    assert [p.name for p in (tmp_path / "claims").glob("[0-9]*")] == ["2"]
    with pytest.raises(ValueError):
        expiry.expire(spark, root, keep=0)


def test_stages_expire(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_folder", lambda _: str(tmp_path))
    assert session.expire_stages(spark, 60) == []
    kept = session.materialise(spark.range(3), "young")
    assert session.expire_stages(spark, 60) == [] and kept.count() == 3
    assert len(session.expire_stages(spark, 60, now=LATER)) == 1
    assert list((tmp_path / "tallyboard").iterdir()) == []


def jobs(spark, run):
    group = f"group-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_metrics_cost_no_job(spark):
    df = spark.range(0, 1000, 1, 7).repartition(5)
    metrics = {"rows": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1)}
    (stored, seen), with_metrics = jobs(spark, lambda: measure(df, "m", metrics))
    assert seen == {"rows": 1000, "odd": 500} and stored.count() == 1000
    assert with_metrics == jobs(spark, lambda: materialise(df, "m"))[1]


def test_metrics_of_an_empty_table(spark):
    stored, seen = measure(spark.range(0), "m", {"rows": F.count("*")})
    assert seen == {"rows": 0} and stored.count() == 0
    empty = spark.range(5).where("id > 9")
    assert measure(empty, "m", {"rows": F.count("*")})[1] == {"rows": 0}
    nothing = spark.createDataFrame([], "id long")
    assert measure(nothing, "m", {"rows": F.count("*")})[1] == {"rows": 0}


def test_refresh_reports_violations(spark, refreshed):
    imported, _ = refreshed
    players = imported["players"].withColumn(
        "name", F.when(F.col("id").endswith("7"), F.repeat(F.lit("x"), 51)).otherwise(F.col("name"))
    )
    tables = imported | {"players": players}
    counted = {}
    found, with_report = jobs(spark, lambda: refresh.refresh_all(tables, violations=counted))
    report = integrity.violation_report(spark, counted)
    expected = integrity.schema_violations(found)
    assert sorted(report.collect()) == sorted(expected.collect())
    assert ("players", "name") in {(r[0], r[1]) for r in report.collect()}
    assert with_report == jobs(spark, lambda: refresh.refresh_all(tables))[1]
