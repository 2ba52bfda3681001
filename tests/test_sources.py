import pytest

from clinops.sources import jdbc
from clinops.sources.tables import UnboundTable, VIEWS, duck_view_sql, load_view, raw

SF = "/root/testdata/sf0.001"


def test_jdbc_options_partitioned_and_plain():
    o = jdbc.jdbc_options("jdbc:postgresql://db/app", "user_vital_measurement", user="u", password="p",
                          partition_column="vital_id", lower=0, upper=1_000_000, num_partitions=64)
    assert o["partitionColumn"] == "vital_id" and o["numPartitions"] == "64" and o["fetchsize"] == "10000"
    plain = jdbc.jdbc_options("jdbc:mysql://db/ops", "treatments")
    assert "partitionColumn" not in plain and "user" not in plain
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "t", partition_column="id", lower=0)
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "t", partition_column="id", lower=5, upper=1, num_partitions=2)


def test_views_bind_and_unbound_names_raise(spark):
    for name in VIEWS:
        df = load_view(spark, SF, name)
        assert df.columns == [n for n, _ in VIEWS[name].columns]
        assert "SELECT" in duck_view_sql(name)
    assert load_view(spark, SF, "user_daily_wellness").count() > 0
    with pytest.raises(UnboundTable):
        load_view(spark, SF, "no_such_view")
    with pytest.raises(ValueError):
        raw(spark, SF, "no_such_table")


def test_reader_memo_and_refresh(spark):
    a = raw(spark, SF, "nation")
    assert raw(spark, SF, "nation") is a
    assert raw(spark, SF, "nation", refresh=True) is not a


def test_bindings_match_declared_schemas(spark):
    from clinops.sources.schema import SCHEMAS
    for name, declared in SCHEMAS.items():
        got = load_view(spark, SF, name).schema
        assert [(f.name, f.dataType) for f in got.fields] == [(f.name, f.dataType) for f in declared.fields], name


def test_submit_writes_a_registered_query(spark):
    import json
    import os
    import tempfile

    from clinops.plans import submit
    out = os.path.join(tempfile.mkdtemp(prefix="clinops-submit-"), "league")
    submit.main(["--key", "league_table", "--input", SF, "--output", out])
    assert spark.read.parquet(out).count() == 30
    snap = os.path.join(os.path.dirname(out), "snap")
    submit.run(spark, "snapshot_json", SF, snap)
    row = spark.read.json(snap).collect()[0]
    assert "gauge" in json.loads(row.snapshot)
    with pytest.raises(ValueError):
        submit.run(spark, "nope", SF, snap)
