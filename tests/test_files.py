"""Updates of stored files."""

import pytest
from pyspark.sql import functions as F

from tallyboard.operators.updates import apply_updates
from tallyboard.session import new_path
from tallyboard.sources import files


@pytest.fixture
def stored(spark):
    rows = spark.range(1000).select(
        F.format_string("k%04d", "id").alias("id"), F.lit(0.0).alias("pp"), F.col("id").alias("n")
    )
    root = new_path(spark, "files")
    assert files.create(rows, root, files=8) == 1
    return rows, root


def paths(spark, root, number):
    return {r.path: r.rows for r in files.manifest(spark, root, number).collect()}


def updated(spark, *ids):
    return spark.createDataFrame([(i, float(k) + 1) for k, i in enumerate(ids)], "id string, pp double")


def test_one_key_rewrites_one_file(spark, stored):
    rows, root = stored
    changes = updated(spark, "k0123")
    assert files.update(spark, root, 1, rows.schema, changes, ["pp"]) == 2
    before, after = paths(spark, root, 1), paths(spark, root, 2)
    assert len(before) == 8 and len(set(before) - set(after)) == 1 and len(after) == 8
    assert sum(after.values()) == 1000
    want = sorted(map(tuple, apply_updates(rows, changes, ["pp"]).collect()))
    assert sorted(map(tuple, files.read(spark, root, 2, rows.schema).collect())) == want
    # readers of the first version keep it
    assert sorted(map(tuple, files.read(spark, root, 1, rows.schema).collect())) == sorted(map(tuple, rows.collect()))


def test_keys_without_a_row_touch_nothing(spark, stored):
    rows, root = stored
    files.update(spark, root, 1, rows.schema, updated(spark, "a", "z"), ["pp"])
    assert paths(spark, root, 2) == paths(spark, root, 1)
    files.update(spark, root, 2, rows.schema, updated(spark), ["pp"])
    assert paths(spark, root, 3) == paths(spark, root, 1)


def test_many_keys_are_looked_up(spark, stored, monkeypatch):
    monkeypatch.setattr(files, "RANGED_KEYS", 2)
    rows, root = stored
    ids = [f"k{k:04d}" for k in (1, 2, 3, 999)] + ["k0500x"]
    files.update(spark, root, 1, rows.schema, updated(spark, *ids), ["pp"])
    # the key that lies within a range but has no row rewrites nothing
    assert len(set(paths(spark, root, 1)) - set(paths(spark, root, 2))) == 2
    got = {r.id: r.pp for r in files.read(spark, root, 2, rows.schema).filter("pp > 0").collect()}
    assert got == {"k0001": 1.0, "k0002": 2.0, "k0003": 3.0, "k0999": 4.0}


def test_second_writer_is_refused(spark, stored):
    rows, root = stored
    files.update(spark, root, 1, rows.schema, updated(spark, "k0001"), ["pp"])
    with pytest.raises(files.Conflict):
        files.update(spark, root, 1, rows.schema, updated(spark, "k0002"), ["pp"])
    assert files.update(spark, root, 2, rows.schema, updated(spark, "k0002"), ["pp"]) == 3
    assert files.read(spark, root, 3, rows.schema).filter("pp > 0").count() == 2


def test_empty_table(spark, stored):
    rows, _ = stored
    root = new_path(spark, "files")
    files.create(rows.limit(0), root)
    files.update(spark, root, 1, rows.schema, updated(spark, "k0001"), ["pp"])
    assert files.read(spark, root, 2, rows.schema).count() == 0
