"""Dumps, import and stored snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from tallyboard.operators.integrity import duplicate_keys
from tallyboard.schema import BOARD_COMPUTED, DUMP_FAMILIES, PLAYER_COMPUTED, SCORE_COMPUTED
from tallyboard.sources import dump, importer, retail, snapshots

SF = "/root/testdata/sf0.001"


def family(base):
    fields = ("predicted_acc", "pass_rating", "acc_rating", "tech_rating", "stars")
    return {f: base + i / 10 for i, f in enumerate(fields)}


DOCUMENT = {
    "players": [{"name": "Ann", "country": "NO", "id": "7", "avatar": "a.png"}],
    "scores": [
        {
            "id": 11,
            "leaderboard_id": "b1",
            "accuracy": 0.97,
            "modifiers": "FS",
            "player_id": "7",
            "timepost": 1700000000,
            "fc": True,
            "fc_acc": 0.98,
        }
    ],
    "maps": [
        {
            "hash": "h",
            "name": "Song",
            "cover_image": "c.png",
            "mapper": "m",
            "id": "b1",
            "song_id": "s1",
            "mode_name": "Standard",
            "difficulty_name": "Hard",
            "acc_rating": 10.0,
            "pass_rating": 8.0,
            "tech_rating": 6.0,
            "modifiers_rating": {c: family(i) for i, c in enumerate(DUMP_FAMILIES)},
        },
        {"id": "b2", "name": "Unrated"},
    ],
}


@pytest.mark.parametrize("multi_line", [True, False])
def test_read_dump_files(spark, tmp_path, multi_line):
    path = tmp_path / "dump.json"
    text = json.dumps(DOCUMENT, indent=1) if multi_line else json.dumps(DOCUMENT)
    # a second document with one list only
    if not multi_line:
        text += "\n" + json.dumps({"players": [{"id": "8", "name": "Bo"}]})
    path.write_text(text)
    tables = importer.import_dump(dump.read_dump(spark, str(path), multi_line))
    assert tables["players"].count() == (1 if multi_line else 2)
    score = tables["scores"].first()
    assert (score.id, score.modifiers, score.fc, score.timepost) == (11, "FS", True, 1700000000)
    assert all(score[c] == 0 for c in SCORE_COMPUTED)
    boards = {r["id"]: r for r in tables["leaderboards"].collect()}
    assert boards["b1"]["cover"] == "c.png"
    assert boards["b1"]["stars"] == pytest.approx(9.373149, abs=1e-6)
    assert boards["b1"]["predicted_acc"] == 0
    assert set(boards["b1"]["modifiers_rating"].asDict()) == {"FS", "SS", "SF"}
    assert boards["b1"]["modifiers_rating"]["FS"]["acc_rating"] == pytest.approx(1.2)
    assert boards["b2"]["modifiers_rating"] is None
    assert boards["b2"]["stars"] == 0 and boards["b2"]["acc_rating"] == 0
    assert all(boards["b1"][c] == 0 for c in BOARD_COMPUTED)
    player = tables["players"].where("id = '7'").first()
    assert player.country == "NO" and all(player[c] == 0 for c in PLAYER_COMPUTED)


def test_a_broken_document_is_an_error(spark):
    lines = spark.createDataFrame([("{not json",)], "value string")
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        dump.parse_dump(lines)["players"].collect()


def test_a_broken_file_is_an_error(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text(json.dumps(DOCUMENT) + "\n{cut off")
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        dump.read_dump(spark, str(path))["players"].collect()


def test_packed_dump_reads_back(spark):
    tables = retail.dump(spark, SF)
    documents = dump.pack_dump(tables, rows_per_document=900)
    assert documents.count() == 7 + 1 + 1
    read = dump.parse_dump(documents)
    for name, df in tables.items():
        assert read[name].schema.simpleString() == df.schema.simpleString()
        assert read[name].exceptAll(df).count() == 0
        assert df.exceptAll(read[name]).count() == 0


def test_written_dump_reads_each_list_alone(spark, tmp_path):
    path = str(tmp_path / "dump")
    tables = retail.dump(spark, SF)
    dump.write_dump(tables, path)
    read = dump.read_dump(spark, path)
    for name, df in tables.items():
        assert read[name].columns == df.columns
        assert read[name].count() == df.count()
        files = read[name].select(F.input_file_name().alias("f")).distinct().collect()
        assert all(f"list={name}/" in row.f for row in files)
        plan = read[name]._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(list" in plan


def test_long_modifier_ratings(spark):
    boards = importer.import_leaderboards(retail.maps(spark, SF))
    rows = importer.modifier_ratings_long(boards)
    rated = boards.where("modifiers_rating is not null").count()
    assert rows.count() == 3 * rated
    one = boards.where("id = '5'").first()["modifiers_rating"]["SF"]
    long = rows.where("leaderboard_id = '5' and code = 'SF'").first()
    assert all(long[f] == one[f] for f in one.asDict())


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "db")
    tables = importer.import_dump(retail.dump(spark, SF))
    first = snapshots.publish_snapshot(tables, root)
    fewer = tables | {"players": tables["players"].limit(3)}
    second = snapshots.publish_snapshot(fewer, root, version="9" + first)
    assert snapshots.latest_version(spark, root) == second
    assert snapshots.read_latest(spark, root)["players"].count() == 3
    old = snapshots.read_snapshot(spark, root, first)
    assert old["players"].count() == 150
    assert old["scores"].schema.simpleString() == tables["scores"].schema.simpleString()
    # a folder without an entry is not seen
    snapshots.write_table(tables["players"], f"{root}/snapshot=99999-unlisted/players", "players")
    assert snapshots.latest_version(spark, root) == second
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, root, "99999-unlisted")


def test_versions_sort_by_time(spark):
    assert snapshots.new_version()[:14].isdigit()


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    players = importer.import_players(retail.players(spark, SF))
    snapshots.append_table(players, path)
    snapshots.append_table(players.limit(1), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 151
    assert duplicate_keys(stored).collect()[0].n == 2


def test_lookup_is_pushed_down(spark, tmp_path):
    """A board lookup reaches the scan of a stored table, and reads what it needs."""
    path = str(tmp_path / "scores")
    snapshots.write_table(importer.import_scores(retail.scores(spark, SF)), path, "scores")
    found = spark.read.parquet(path).where(F.col("leaderboard_id") == "7").select("id", "pp")
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(leaderboard_id,7)" in plan
    assert "ReadSchema: struct<id:bigint,leaderboard_id:string,pp:double>" in plan


def test_last_published_is_latest(spark, tmp_path):
    root = str(tmp_path / "db")
    assert snapshots.latest_version(spark, root) is None
    for k in range(12):
        name = "zz-trial" if k == 3 else None
        version = snapshots.publish_snapshot({"t": spark.range(k, k + 1)}, root, name)
        assert snapshots.latest_version(spark, root) == version
        assert snapshots.read_latest(spark, root)["t"].first().id == k


def test_order_lines_move_once(spark, tmp_path):
    """Lines that repeat a key are numbered where they meet their order, after one shuffle."""
    lines = [(1, 7, 3, 1, 5.0, 100.0, 0.05, 0.02), (1, 7, 3, 1, 6.0, 100.0, 0.05, 0.02), (2, 8, 3, 1, 5.0, 90.0, 0.01, 0.0)]
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    more = "'R' l_returnflag", "'O' l_linestatus", "date'1997-01-02' l_shipdate"
    df = spark.createDataFrame(lines, line).selectExpr("*", *more)
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.createDataFrame([(1, 5), (2, 4)], "o_orderkey long, o_custkey long")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = retail.scores(spark, str(tmp_path))
        plan = scores._jdf.queryExecution().executedPlan().toString()
        found = {(r.id, r.leaderboard_id, round(r.accuracy, 4), r.player_id) for r in scores.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert found == {(9, "7", 0.89, "5"), (9 + 2**40, "7", 0.889, "5"), (17, "8", 0.975, "4")}
