"""Cells of one-row snapshots: list places, nested lists, missing values; order of the newest-n lists."""

import datetime as dt

from clinops.operators import vitals
from clinops.plans.snapshot import snapshot_cells
from tests.conftest import rows


def test_cells_of_every_shape(spark):
    df = spark.sql("""SELECT named_struct('n', 3L, 't', 'a', 'xs', array(1.5D, null)) AS one,
                             array(named_struct('k', 'p', 'ys', array('u', 'v')), named_struct('k', null, 'ys', array())) AS many,
                             true AS flag, cast(null AS string) AS nothing,
                             cast(array() AS array<struct<k: string>>) AS empty""")
    assert rows(snapshot_cells(df), "block", "position", "field", "item", "text", "number") == sorted([
        ("one", 0, "n", 0, None, 3.0), ("one", 0, "t", 0, "a", None), ("one", 0, "xs", 0, None, 1.5),
        ("one", 0, "xs", 1, None, None), ("many", 0, "k", 0, "p", None), ("many", 0, "ys", 0, "u", None),
        ("many", 0, "ys", 1, "v", None), ("many", 1, "k", 0, None, None), ("flag", 0, "flag", 0, "true", None),
        ("nothing", 0, "nothing", 0, None, None)], key=lambda t: tuple((x is None, str(x)) for x in t))


def test_newest_events_carry_their_place(spark):
    day = dt.date(2024, 1, 5)
    events = spark.createDataFrame(
        [(i, 7, "LAB", day - dt.timedelta(days=i % 2), None, "t", f"S{i}", None) for i in range(1, 6)],
        "clinical_event_id long, patient_no long, category string, occurred_on date, department string, title string, "
        "status string, source_mysql_treatment_id long")
    got = vitals.recent_events(events, 3, with_order=True).orderBy("ordinal").select("ordinal", "status").collect()
    assert [tuple(r) for r in got] == [(1, "S4"), (2, "S2"), (3, "S5")]
    assert "ordinal" not in vitals.recent_events(events, 3).columns
