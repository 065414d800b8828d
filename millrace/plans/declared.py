"""Declared pipelines: datasets by the decorators of pyspark.pipelines, run in the session there is.

    graph = Graph()
    with graph:
        @dp.table
        def changes(): return spark.readStream...          # a streaming table
        @dp.materialized_view
        def orders(): return latest(spark.table("changes"))
    graph.run(spark, folder, "a_database")

The command that runs such definitions needs a Connect server and grpc. Here a
definition is run as it stands: a streaming table by an available-now stream with
a checkpoint of its own, so a second run takes only what is new; a materialized
view is computed anew; a temporary view lives as long as the run. Definitions may
come in any order: one that reads a dataset that is not there yet waits for it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.pipelines.flow import Flow
from pyspark.pipelines.graph_element_registry import GraphElementRegistry, graph_element_registration_context
from pyspark.pipelines.output import MaterializedView, Output, Sink, StreamingTable, TemporaryView
from pyspark.sql import DataFrame, SparkSession


class GraphError(RuntimeError):
    """A definition that cannot be run."""


class Graph(GraphElementRegistry):
    """The datasets and flows that were defined inside `with graph:`."""

    def __init__(self):
        self.outputs: dict[str, Output] = {}
        self.flows: dict[str, Flow] = {}

    def __enter__(self) -> Graph:
        self._context = graph_element_registration_context(self)
        self._context.__enter__()
        return self

    def __exit__(self, *raised) -> None:
        self._context.__exit__(*raised)

    def register_output(self, output: Output) -> None:
        if output.name in self.outputs:
            raise GraphError(f"{output.name} is defined twice")
        if isinstance(output, Sink):
            raise GraphError(f"{output.name}: sinks outside the database are not run here")
        self.outputs[output.name] = output

    def register_flow(self, flow: Flow) -> None:
        if flow.name in self.flows:
            raise GraphError(f"flow {flow.name} is defined twice")
        self.flows[flow.name] = flow

    def register_sql(self, sql_text: str, file_path) -> None:
        raise GraphError("definitions in SQL files are not run here")

    def run(self, spark: SparkSession, folder: str, database: str) -> list[str]:
        """Bring all datasets up to date in a database kept in the folder; their names in the order that they ran."""
        if lost := {f.target for f in self.flows.values()} - set(self.outputs):
            raise GraphError(f"flows into nothing: {', '.join(sorted(lost))}")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}/tables'")
        before, views = spark.catalog.currentDatabase(), []
        spark.catalog.setCurrentDatabase(database)
        try:
            left, done = list(self.flows.values()), []
            while left:
                waits = []
                for flow in left:
                    # A dataset is whole when all flows into it have run; only then others may read it.
                    rows = self._rows(flow, {f.target for f in left})
                    if rows is None:
                        waits.append(flow)
                        continue
                    self._put(flow, rows, folder)
                    views += [flow.target] if isinstance(self.outputs[flow.target], TemporaryView) else []
                    done.append(flow.name)
                if len(waits) == len(left):
                    raise GraphError(f"these wait for one another or for nothing there is: {', '.join(f.name for f in waits)}")
                left = waits
            return done
        finally:
            for view in views:
                spark.catalog.dropTempView(view)
            spark.catalog.setCurrentDatabase(before)

    def _rows(self, flow: Flow, open_: set[str]) -> DataFrame | None:
        """What the flow reads; None if that is a dataset which is not there yet."""
        try:
            rows = flow.func()
        except AnalysisException as error:
            if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" and any(f"`{n}`" in str(error) for n in open_ - {flow.target}):
                return None
            raise
        if not isinstance(rows, DataFrame):
            raise GraphError(f"flow {flow.name} gives no DataFrame")
        return rows

    def _put(self, flow: Flow, rows: DataFrame, folder: str) -> None:
        output = self.outputs[flow.target]
        if isinstance(output, TemporaryView):
            rows.createOrReplaceTempView(output.name)
            return
        if rows.isStreaming != isinstance(output, StreamingTable):
            raise GraphError(f"{output.name}: a streaming table takes a stream, a materialized view takes none")
        kind = output.format or "parquet"
        if isinstance(output, MaterializedView):
            writer = rows.write.format(kind).mode("overwrite")
            (writer.partitionBy(*output.partition_cols) if output.partition_cols else writer).saveAsTable(output.name)
            return
        writer = rows.writeStream.format(kind).outputMode("append").option("checkpointLocation", f"{folder}/checkpoints/{flow.name}")
        if output.partition_cols:
            writer = writer.partitionBy(*output.partition_cols)
        writer.trigger(availableNow=True).toTable(output.name).awaitTermination()
