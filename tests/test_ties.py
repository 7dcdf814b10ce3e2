"""Rankings of rows that tie in all that the order names are those of the ids, whatever the order of rows."""

from __future__ import annotations

import itertools

import pytest

from citemill.operators import ranking

EDGE = "from_id string, to_id string, pos bigint, citation_count bigint, is_influential boolean, intents array<string>"


def in_any_order(rows, rank, data):
    return {tuple(tuple(r) for r in rank(rows(EDGE, *x).coalesce(1)).orderBy("rank").collect()) for x in itertools.permutations(data)}


def test_top_references(rows):
    data = [("a", t, 1, 5, True, ["methodology"]) for t in ("z", "x", "y")]
    found = in_any_order(rows, lambda e: ranking.top_references(e, 2).select("to_id", "rank"), data)
    assert found == {(("x", 1), ("y", 2), ("z", 3))}


@pytest.mark.parametrize("or_anything", [False, True])
def test_candidates(rows, or_anything):
    """A tie at the last place, and rows of one paper that differ in their tier."""
    data = [("a", "z", 1, 5, True, ["methodology"]), ("a", "x", 1, 5, True, []), ("a", "x", 1, 5, False, ["methodology"])]
    found = in_any_order(rows, lambda e: ranking.candidates(e, "from_id", 3, or_anything).select("to_id", "tier", "rank"), data)
    assert found == {(("x", 1, 1), ("x", 2, 2), ("z", 1, 3))}
