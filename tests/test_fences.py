"""Pages between fences against slices of the whole listing."""

import pytest

from tallyboard.config import SkewPolicy
from tallyboard.plans import fences

ROWS = [(k, "ab"[k % 2], None if k % 9 == 0 else float(k * 7 % 5)) for k in range(1, 48)]


@pytest.fixture(scope="module")
def listing(spark):
    return spark.createDataFrame(ROWS, "id long, owner string, value double")


def ordered(rows, descending):
    key = lambda r: (r[2] is None, -(r[2] or 0)) if descending else (r[2] is not None, r[2] or 0)
    return sorted(rows, key=lambda r: (key(r), r[0]))


@pytest.mark.parametrize("descending", [False, True])
def test_every_page(listing, descending):
    marks = fences.fences(listing, "value", descending, 10, policy=SkewPolicy(hot_rows=5, chunk_rows=9))
    whole = ordered(ROWS, descending)
    assert fences.last_page(marks) == 5
    for number in range(1, 7):
        found = fences.fenced_page(listing, marks, "value", descending, number, 10)
        assert list(map(tuple, found.collect())) == whole[(number - 1) * 10 : number * 10]


@pytest.mark.parametrize("descending", [False, True])
def test_rows_after(listing, descending):
    whole = ordered(ROWS, descending)
    seen = [whole[0]]
    while len(seen) < len(whole):
        last = seen[-1]
        after = fences.rows_after(listing, "value", descending, last[2], last[0], 15)
        seen += map(tuple, after.collect())
    assert seen == whole


def test_listings_of_owners(listing):
    marks = fences.fences(listing, "value", True, 10, ["owner"])
    own = ordered([r for r in ROWS if r[1] == "b"], True)
    found = fences.fenced_page(
        listing.where("owner = 'b'"), marks.where("owner = 'b'"), "value", True, 2, 10
    )
    assert list(map(tuple, found.collect())) == own[10:20]


def test_no_rows(listing):
    none = listing.limit(0)
    marks = fences.fences(none, "value", True, 10)
    assert fences.last_page(marks) == 0
    assert fences.fenced_page(none, marks, "value", True, 1, 10).count() == 0


def test_bounds_reach_the_scan(spark, refreshed, capsys):
    from tallyboard.session import materialise

    boards = materialise(refreshed[1]["leaderboards"], "boards")
    marks = fences.fences(boards, "total_pp", True, 50)
    fences.fenced_page(boards, marks, "total_pp", True, 30, 50).explain()
    assert "total_pp" in capsys.readouterr().out.split("PushedFilters: ")[1].split("]")[0]
