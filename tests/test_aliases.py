"""Saved aliases in the registered flows."""

import pytest

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["group_routing_aliases", "stream_intake_aliases", "reconcile_aliases"])
def test_flow_with_saved_aliases_is_that_of_its_sql(spark, name):
    import __spark_entry__ as entry
    from checks import harness

    rows, same, why = harness.compare(spark, harness.duck(TINY), TINY, entry.queries()[name], entry.oracle_sql()[name])
    assert rows and same, why


def test_arrival_with_an_alias_goes_to_the_folder_of_its_saved_name(spark):
    from shelfmark.operators import cluster as C
    from shelfmark.streaming import live

    arrivals = spark.createDataFrame([("[Brand] old name v2.zip",), ("[Brand] other name v2.zip",)], "name string")
    index = C.alias_index(spark.createDataFrame([("Old Name", "New Name")], "alias string, canonical string"))
    library = spark.createDataFrame([("/lib0", "NEW NAME/x.zip")], "root string, rel string")
    got = {r.name: r.destination for r in live.intake(arrivals, index, library, "/lib0").collect()}
    assert got["[Brand] old name v2.zip"] == "/lib0/NEW NAME/[Brand] old name v2.zip"
    assert got["[Brand] other name v2.zip"].startswith("/lib0/other name/")
