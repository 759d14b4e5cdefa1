from conftest import SF

import __spark_entry__


def test_visible_rows_are_not_sorted_for_a_join(spark):
    """a task's memory doesn't grow with the rows that it would have to sort."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        rows = __spark_entry__.queries()["own_or_admin"](spark, SF)
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
