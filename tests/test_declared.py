import os

import pytest
from pyspark import pipelines as dp
from pyspark.sql import functions as F

from millrace.plans import declared

SHAPE = "id long, kind string"


def graph_over(spark, source):
    graph = declared.Graph()
    with graph:

        @dp.materialized_view(partition_cols=["kind"])
        def counted():
            return spark.table("named").groupBy("kind").agg(F.count("*").alias("n"))

        @dp.temporary_view
        def named():
            return spark.table("landed_rows").where("kind IS NOT NULL")

        @dp.table
        def landed_rows():
            return spark.readStream.schema(SHAPE).parquet(str(source))

    return graph


def land(spark, rows, source, name):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(source / f".{name}"))
    os.rename(next((source / f".{name}").glob("part-*.parquet")), source / f"{name}.parquet")


def test_a_graph_runs_in_the_order_of_its_reads_and_takes_only_what_is_new(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    land(spark, [(1, "a"), (2, None)], source, "one")
    folder = f"file:{tmp_path}/work"
    assert graph_over(spark, source).run(spark, folder, "declared_db") == ["landed_rows", "named", "counted"]
    got = lambda: sorted(map(tuple, spark.table("declared_db.counted").select("kind", "n").collect()))
    assert got() == [("a", 1)]
    land(spark, [(3, "a"), (4, "b")], source, "two")
    graph_over(spark, source).run(spark, folder, "declared_db")
    graph_over(spark, source).run(spark, folder, "declared_db")
    assert got() == [("a", 2), ("b", 1)] and spark.table("declared_db.landed_rows").count() == 4
    assert spark.catalog.currentDatabase() == "default" and not spark.catalog.tableExists("named")


def test_what_cannot_run_is_refused(spark, tmp_path):
    graph = declared.Graph()
    with graph:

        @dp.materialized_view
        def one():
            return spark.table("two")

        @dp.materialized_view
        def two():
            return spark.table("one")

        with pytest.raises(declared.GraphError, match="twice"):
            dp.materialized_view(lambda: None, name="one")
    with pytest.raises(declared.GraphError, match="wait"):
        graph.run(spark, f"file:{tmp_path}/a", "declared_a")
    graph = declared.Graph()
    with graph:

        @dp.materialized_view
        def stream():
            return spark.readStream.format("rate").load()

    with pytest.raises(declared.GraphError, match="takes none"):
        graph.run(spark, f"file:{tmp_path}/b", "declared_b")
