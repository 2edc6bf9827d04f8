"""The index of letter triples finds what a scan finds."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyboard.plans import pages, search

NAMES = [
    "Red Ring", "red ring two", "RING", "ri", "", None, "aaa", "aaaaaa", "100%_done", "a_b%c",
    "back\\slash", "ÄÖÜ straße", "äöü", "Red  Ring", "ring red", "日本語の名前", "aab aba baa",
]


@pytest.fixture(scope="module")
def boards(spark):
    rows = [(str(i), name) for i, name in enumerate(NAMES)]
    return spark.createDataFrame(rows, "id string, name string").coalesce(1)


@pytest.fixture(scope="module")
def index(spark, boards, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "names")
    search.write_index(boards, path)
    return search.read_index(boards, path)


def _ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("literal", [True, False])
@pytest.mark.parametrize(
    "text",
    [None, "", "RED ring", "ri", "ring%", "re_ ring", "%red%ring", "aaa", "aaaa", "100%_d", "_b%c",
     "K\\SL", "äÖü", "STRASSE", "日本語", "語の名", "aba baa", "%%%", "___", "nowhere"],
)
def test_same_as_a_scan(boards, index, text, literal):
    plain = pages.search_contains if literal else pages.search_like
    assert _ids(search.search(boards, index, text, literal)) == _ids(plain(boards, text))


@given(st.text(alphabet="aAbB%_ ", max_size=12), st.text(alphabet="aAbB%_ ", max_size=30))
@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
def test_asked_triples_are_held_by_every_match(text, filling):
    parts = text.lower().replace("_", "x").split("%")
    match = filling.lower() + filling.lower().join(parts) + filling.lower()
    assert all(triple in match for triple in search.asked(text, False))
    assert all(triple in text.lower() for triple in search.asked(text, True))


def test_triples_by_brute_force(boards, index):
    expected = sorted(
        {(n.lower()[k : k + 3], str(i)) for i, n in enumerate(NAMES) if n for k in range(len(n) - 2)}
    )
    assert sorted(map(tuple, index.collect())) == expected


def test_no_names(spark, boards, tmp_path):
    none = boards.limit(0)
    search.write_index(none, str(tmp_path / "none"))
    assert search.search(none, search.read_index(none, str(tmp_path / "none")), "ring").count() == 0


def test_triples_reach_the_scan(boards, index):
    plan = search.search(boards, index, "red ring")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(triple, [" in plan
