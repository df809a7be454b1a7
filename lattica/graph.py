"""The session: a graph that queries read and replace."""

from __future__ import annotations

import threading
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lattica.model import PropertyGraph
from lattica.operators.writes import Writer
from lattica.plans.ast import Clause, CypherError, Query, walk
from lattica.plans.lower import Lowerer
from lattica.plans.parser import parse
from lattica.plans.validate import validate


class Graph:
    """Runs queries over a property graph.

    ``cypher`` reads and writes, ``read`` refuses to write. A write replaces ``current`` by a new graph; DataFrames handed out before keep
    reading the old one.
    """

    def __init__(self, current: PropertyGraph):
        self.current = current

    @property
    def spark(self) -> SparkSession:
        return self.current.spark

    def cypher(self, text: str, params: dict[str, Any] | None = None, **more: Any) -> DataFrame:
        """The result of a query as a lazy DataFrame; writes take place at once."""
        return self._run(text, {**(params or {}), **more}, Writer())

    def read(self, text: str, params: dict[str, Any] | None = None, **more: Any) -> DataFrame:
        """Like ``cypher``, but a query that writes is refused."""
        return self._run(text, {**(params or {}), **more}, None)

    def rows(self, text: str, params: dict[str, Any] | None = None, timeout: float | None = None) -> list[Any]:
        """The collected rows of a read query; its jobs are cancelled after ``timeout`` seconds."""
        group, context = f"cypher-{uuid.uuid4().hex}", self.spark.sparkContext
        timer = threading.Timer(timeout, context.cancelJobGroup, [group]) if timeout else None
        context.setJobGroup(group, text[:100], interruptOnCancel=True)
        try:
            if timer:
                timer.start()
            return self.read(text, params).collect()
        finally:
            if timer:
                timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def _run(self, text: str, params: dict[str, Any], writer: Any) -> DataFrame:
        query = parse(text)
        validate(query)
        if query.writes and writer is None:
            raise CypherError("WriteInReadQuery", text[:60])
        if query.mode == "explain":
            return self._explained(query, params, None)
        low = Lowerer(self.current, params, writer)
        out = low.run(query)
        self.current = low.graph
        return self._explained(query, params, out) if query.mode == "profile" else out

    def _explained(self, query: Query, params: dict[str, Any], ran: DataFrame | None) -> DataFrame:
        """One row per line: the clauses, then Spark's physical plan; a profile adds rows and seconds."""
        lines = [f"{'  ' * k}{type(c).__name__}" for branch in query.branches for k, c in enumerate(branch)]
        if ran is None and not query.writes:
            ran = Lowerer(self.current, params, None).run(query)
            timed: list[str] = []
        elif ran is not None:
            began = time.time()
            timed = [f"rows: {ran.count()}", f"seconds: {time.time() - began:.3f}"]
        else:
            return self.spark.createDataFrame([(x,) for x in lines], "plan string")
        plan = ran._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(x,) for x in [*lines, *timed, *plan.splitlines()]], "plan string")

    def status(self) -> dict[str, Any]:
        """Labels, types and sizes."""
        g = self.current
        return {"labels": g.labels(), "types": g.types(), "nodes": sum(t.df.count() for t in g.nodes), "relationships": sum(t.df.count() for t in g.edges)}


class Graphs:
    """Named graphs, one per tenant."""

    def __init__(self, spark: SparkSession):
        self.spark, self.all = spark, {}

    def get(self, name: str = "default") -> Graph:
        return self.all.setdefault(name, Graph(PropertyGraph(self.spark)))

    def list(self) -> list[str]:
        return sorted(self.all)

    def delete(self, name: str) -> None:
        self.all.pop(name, None)


__all__ = ["Clause", "CypherError", "Graph", "Graphs", "walk"]
