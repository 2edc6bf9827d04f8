"""Documents cut between elements: any split gives the tables of the plain reader."""

import json

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyboard.schema import DUMP_DOCUMENT
from tallyboard.sources import cut, dump

SIZE = "spark.sql.files.maxPartitionBytes"


def rows(tables):
    return {name: sorted(map(repr, df.collect())) for name, df in tables.items()}


def both(spark, folder, split):
    spark.conf.set(SIZE, str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        found = cut.read_dump_cut(spark, folder)
        return rows(found), rows(dump.read_dump(spark, folder, multi_line=True))
    finally:
        spark.conf.unset(SIZE)
        spark.conf.unset("spark.sql.files.openCostInBytes")


TRICKY = ['a "quoted" }, {', "back\\", '\\"', "},{", '"scores":[{', "]}", "ünïcødé 日本", "", " "]


def document(n):
    text = lambda i: TRICKY[i % len(TRICKY)]
    family = {"predicted_acc": 0.9, "pass_rating": 1.0, "acc_rating": 2.0, "tech_rating": 3.0, "stars": 4.0}
    return {
        "players": [{"name": text(i), "country": "NO", "id": f"p{i}", "avatar": text(i + 1)} for i in range(n)],
        "scores": [{"id": i, "leaderboard_id": "b", "modifiers": text(i), "fc": i % 2 == 0} for i in range(3 * n)],
        "maps": [
            {"hash": text(i), "name": text(i + 2), "id": f"m{i}", "modifiers_rating": {"SS": family, "FS": family}}
            for i in range(n)
        ],
    }


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", [150, 1 << 27])
def test_one_document(spark, tmp_path, split, indent):
    (tmp_path / "one.json").write_text(json.dumps(document(9), indent=indent, ensure_ascii=False))
    found, expected = both(spark, str(tmp_path), split)
    assert found == expected
    assert [len(v) for v in found.values()] == [9, 27, 9]


def test_many_tasks_read_one_document(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(document(300)))
    spark.conf.set(SIZE, str(path.stat().st_size // 4))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        pieces = cut._pieces(spark, str(tmp_path))
        assert pieces.select("_block").distinct().count() >= 4
    finally:
        spark.conf.unset(SIZE)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_text_does_not_move(spark, tmp_path):
    """Neither to the sort of its split nor into the documents of a dump."""
    (tmp_path / "one.json").write_text(json.dumps(document(9)))
    pieces = cut._pieces(spark, str(tmp_path))
    assert "Exchange" not in pieces._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(str(i),) for i in range(25)], "id string").repartition(2)
    packed = dump.pack_dump(dict.fromkeys(dump.TABLES, rows.withColumn("none", F.lit(None))), 10)
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    read = [json.loads(r.value) for r in packed.collect()]
    for name in dump.TABLES:
        parts = [d[name] for d in read if name in d]
        assert sorted(int(x["id"]) for part in parts for x in part) == list(range(25))
        assert max(map(len, parts)) <= 10


def test_elements_over_many_splits(spark, tmp_path):
    """Elements larger than several splits, between small ones, in lists that began earlier."""
    long = [{"id": f"{i}", "name": "}" * (400 if i % 3 == 0 else 2)} for i in range(12)]
    text = json.dumps({"players": long, "other": [{"a": {"b": ["}{", 1]}}], "maps": [{"id": "m"}]})
    (tmp_path / "long.json").write_text(text + "\n" + json.dumps({"players": long[:2]}))
    spark.conf.set(SIZE, "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        found = rows(cut.read_dump_cut(spark, str(tmp_path)))
    finally:
        spark.conf.unset(SIZE)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == rows(dump.read_dump(spark, str(tmp_path)))
    assert [len(found[name]) for name in ("players", "scores", "maps")] == [14, 0, 1]


def test_other_splits_at_the_second_read_stop_it(spark, tmp_path, monkeypatch):
    (tmp_path / "one.json").write_text(json.dumps(document(9)))
    first = cut._blocks
    monkeypatch.setattr(cut, "_blocks", lambda pieces: first(pieces).withColumn("_block", F.col("_block") + 1))
    with pytest.raises(Exception, match="split anew"):
        rows(cut.read_dump_cut(spark, str(tmp_path)))


values = st.text(alphabet='ab"\\{}[]:, é\n', max_size=12)
players = st.lists(st.fixed_dictionaries({"id": values, "name": st.none() | values}), max_size=6)
documents = st.fixed_dictionaries(
    {}, optional={"players": players, "maps": st.lists(st.fixed_dictionaries({"id": values}), max_size=4)}
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(documents, max_size=4), st.integers(16, 80))
def test_any_documents(spark, tmp_path_factory, some, split):
    """Several documents in one file, one per line."""
    folder = tmp_path_factory.mktemp("some")
    (folder / "some.json").write_text("\n".join(map(json.dumps, some)) + "\n")
    spark.conf.set(SIZE, str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        found = rows(cut.read_dump_cut(spark, str(folder)))
    finally:
        spark.conf.unset(SIZE)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == rows(dump.read_dump(spark, str(folder)))


@pytest.mark.parametrize(
    "text", ['{"players":[{"id":"a"},{"id":"b"', '{"players":[{"id":"a"}]', '{"players":[{"id":"a"}]}]}', '{"players":[{"id" "a"}]}']
)
def test_broken_documents_stop_the_read(spark, tmp_path, text):
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(Exception, match="not a whole document|MALFORMED|PARSE"):
        rows(cut.read_dump_cut(spark, str(tmp_path)))


def test_empty_lists(spark, tmp_path):
    (tmp_path / "empty.json").write_text('{ "players": [], "scores" : [ ],\n"maps":[]}\n')
    assert rows(cut.read_dump_cut(spark, str(tmp_path))) == {f.name: [] for f in DUMP_DOCUMENT}


def scanned_by_character(text, inside):
    """(quotes, change of depth) of a piece, the } after it included."""
    quotes, depth, escaped = 0, 0, False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quotes, inside = quotes + 1, not inside
        elif not inside:
            depth += (c in "{[") - (c == "]")
    return quotes, depth - (not inside), inside


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a"\\{[],é\n', max_size=9), min_size=1, max_size=8), st.integers(0, 3), st.integers(0, 2))
def test_a_scan_of_bytes_is_one_of_characters(texts, quotes, skipped):
    """Also of a part of an array, where a backslash ends a piece and after empty pieces."""
    array = pa.array(["\\"] * skipped + texts, pa.string()).slice(skipped)
    states = [quotes % 2 == 1, quotes % 2 == 0]
    expected = []
    for text in texts:
        found = [scanned_by_character(text, inside) for inside in states]
        states = [inside for _, _, inside in found]
        expected.append((found[0][0], found[0][1], found[1][1]))
    assert list(zip(*(n.tolist() for n in cut._scan(array, quotes)))) == expected


def test_the_text_is_not_taken_apart_by_patterns(spark, tmp_path):
    """Nor do readers of one list read the elements of others."""
    (tmp_path / "one.json").write_text(json.dumps(document(9)))
    pieces = cut._pieces(spark, str(tmp_path))
    assert "regexp" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    read = cut.read_dump_cut(spark, str(tmp_path))
    plan = read["players"]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(list,players)" in plan


def test_long_texts_are_scanned_in_parts(spark, tmp_path, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"_file": ["f"] * 9, "_block": [0] * 5 + [1] * 4, "value": ["x" * 99] * 9})
    monkeypatch.setattr(cut, "_SCANNED", batch.nbytes // 4)
    parts = [(split, len(rows)) for split, rows in cut._stretches(batch)]
    assert parts == [(("f", 0), 2), (("f", 0), 2), (("f", 0), 1), (("f", 1), 2), (("f", 1), 2)]
