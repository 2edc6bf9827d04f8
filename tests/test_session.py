"""Scratch folder and session advice."""

from pathlib import Path

import pytest

from tallyboard import session


def test_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_folder(spark) == folder.rstrip("/")
    paths = {session.new_path(spark, "x") for _ in range(3)}
    assert len(paths) == 3 and all(p.startswith(folder) for p in paths)


class Unset:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId = master, f"application on {master}"

    def get(self, name, default):
        return default


def test_a_cluster_must_name_the_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_folder(Unset("yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_folder(Unset("local-cluster[2,1,1024]"))
    local = Unset("local[4]")
    assert session.scratch_folder(local) == session.scratch_folder(local)


def test_materialise(spark):
    df = spark.range(10).selectExpr("id", "if(id % 2 = 0, null, cast(id as string)) s")
    stored = session.materialise(df, "numbers")
    assert stored.schema == df.schema or stored.dtypes == df.dtypes
    assert stored.exceptAll(df).count() == 0 and stored.count() == 10
    assert "Scan" in stored._jdf.queryExecution().executedPlan().toString()


def test_sized_shuffles(spark):
    name = "spark.sql.shuffle.partitions"
    with session.sized_shuffles(spark, 300_000_000):
        assert 150 < int(spark.conf.get(name)) <= 200
    assert spark.conf.get(name) == "8"


def test_shuffle_partitions():
    assert session.shuffle_partitions(1000, 8) == 8
    assert 150 < session.shuffle_partitions(300_000_000, 8) <= 200
    assert session.shuffle_partitions(10**12, 8) == 100_000


def test_stages_are_removed(spark, tmp_path):
    from pathlib import Path

    from tallyboard.session import materialise, own_stages, scratch_folder

    folder = Path(scratch_folder(spark)) / "tallyboard"
    before = materialise(spark.range(3), "kept")
    there = set(folder.iterdir())
    with pytest.raises(ValueError), own_stages(spark):
        materialise(spark.range(4), "gone")
        with own_stages(spark):
            inner = materialise(spark.range(5), "inner")
            inner.write.parquet(str(tmp_path / "result"))
        assert len(set(folder.iterdir()) - there) == 1
        raise ValueError
    assert set(folder.iterdir()) == there and before.count() == 3
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5


def test_rows_that_are_sorted_get_more_partitions(spark):
    """Few enough rows for a task to sort in memory, whatever the session's number is."""
    name, rows = "spark.sql.shuffle.partitions", 36_000_000
    with session.sized_shuffles(spark, rows, session.SORTED):
        assert rows / int(spark.conf.get(name)) < 250_000
    assert spark.conf.get(name) == "8"


def test_sorted_partitions_are_not_merged_again(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    with session.sized_shuffles(spark, 1000, 4 * session.SORTED):
        assert spark.conf.get(name) == f"{2**24}b"
    assert spark.conf.get(name) == before
    spark.conf.set(name, "1m")
    with session.sized_shuffles(spark, 1000, 4 * session.SORTED):
        assert spark.conf.get(name) == f"{2**20}b"
    assert spark.conf.get(name) == "1m"
    spark.conf.set(name, before)


def test_a_refresh_sorts_small_partitions(refreshed, monkeypatch):
    from tallyboard.plans import refresh

    imported, _ = refreshed
    asked, sized = [], session.sized_shuffles
    monkeypatch.setattr(
        refresh, "sized_shuffles", lambda spark, *sizes: asked.append(sizes) or sized(spark, *sizes)
    )
    refresh.refresh_all(imported, only=["scores"], stored=True)
    assert asked == [(imported["scores"].count(), session.SORTED)]


def test_stages_are_compressed(spark, tmp_path):
    from pathlib import Path

    from tallyboard.sources.snapshots import write_table

    session.materialise(spark.range(10), "compressed")
    write_table(spark.range(10), str(tmp_path / "table"), "leaderboards")
    folder = Path(session.scratch_folder(spark)) / "tallyboard"
    stage = next(folder.glob("compressed-*"))
    for written in (stage, tmp_path / "table"):
        files = list(written.glob("*.parquet"))
        assert files and all(".zstd." in f.name for f in files)


def test_shuffle_files_go_when_a_stage_is_written(spark, tmp_path):
    """They do not wait for the driver's garbage collection."""
    import time

    from tallyboard.sources.snapshots import write_table

    def shuffled():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = disk.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {name for name in names if name.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name)
    rows = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    kept = rows.collect()
    assert shuffled() - before  # a collected result keeps its files
    before |= shuffled()
    stage = session.materialise(rows, "aggregated")
    write_table(spark.range(1000), str(tmp_path / "table"), "leaderboards")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert stage.count() == len(kept) == 7 and rows.count() == 7
    assert spark.conf.get(name) == setting


def test_keys_and_points_are_written_without_dictionaries(spark, tmp_path):
    import pyarrow.parquet as pq

    from tallyboard.sources.snapshots import write_table

    rows = spark.range(1000).selectExpr("id", "id * 0.37 AS pp", "id % 3 AS rank", "id * 0.1D AS acc_pp", "'x' AS pp_name")
    write_table(rows.coalesce(1), str(tmp_path / "table"), "leaderboards")
    session.materialise(rows.coalesce(1), "undictionaried")
    stage = next((Path(session.scratch_folder(spark)) / "tallyboard").glob("undictionaried-*"))
    for folder in (tmp_path / "table", stage):
        group = pq.ParquetFile(next(folder.glob("*.parquet"))).metadata.row_group(0)
        columns = [group.column(i) for i in range(group.num_columns)]
        known = {c.path_in_schema: any("DICT" in e for e in c.encodings) for c in columns}
        assert known == {"id": False, "pp": False, "acc_pp": False, "rank": True, "pp_name": True}
