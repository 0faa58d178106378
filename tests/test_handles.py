"""Handles that the directory lacks."""

from __future__ import annotations

from chronolore.operators import resolve

ROWS = "episode_id string, system string, raw_id string, label string, person_id string, method string, rationale string"


def test_missing_handles(spark):
    rows = [
        ("e1", "SLACK", "U1", "ann", None, "UNRESOLVED", "x"), ("e2", "SLACK", "U1", "Ann", None, "UNRESOLVED", "x"), ("e2", "SLACK", "U1", "Ann", None, "UNRESOLVED", "x"),
        ("e1", "SLACK", "U2", "bob", "p2", "HANDLE", "x"), ("e3", "ZOOM", "Z1", "guest", None, "UNRESOLVED", "x"), ("e3", "NOTION", "N1", None, None, "UNRESOLVED", "x"),
        ("e4", "NOTION", None, "nobody", None, "UNRESOLVED", "x"), ("e4", "FILESYSTEM", " ", "file", None, "UNRESOLVED", "x"), (None, None, None, None, None, None, None),
    ]
    found = {tuple(r) for r in resolve.missing_handles(spark.createDataFrame(rows, ROWS)).collect()}
    assert found == {("SLACK", "U1", "Ann", 2), ("NOTION", "N1", None, 1)}
    assert resolve.missing_handles(spark.createDataFrame([], ROWS)).count() == 0
