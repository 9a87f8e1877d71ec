"""The graph handle: two DataFrames, and the sources and files that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``nodes`` and ``edges`` follow :mod:`loomgraph.schemas`; ``sources`` and ``files`` are optional. Everything is lazy.

    ``incoming`` may hold the same edges clustered by ``to_id``, for look-ups in that direction.
    """

    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame | None = None
    files: DataFrame | None = None
    incoming: DataFrame | None = None

    def adjacent(self, direction: str) -> DataFrame:
        """The edges, in the clustering that suits look-ups by their near end."""
        return self.incoming if direction == "in" and self.incoming is not None else self.edges

    def node(self, id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == id)

    def named(self, name: str) -> DataFrame:
        return self.nodes.filter(F.col("name") == name)

    def edges_from(self, id: str, kind: str | None = None) -> DataFrame:
        found = self.edges.filter(F.col("from_id") == id)
        return found if kind is None else found.filter(F.col("kind") == kind)

    def edges_to(self, id: str, kind: str | None = None) -> DataFrame:
        found = self.adjacent("in").filter(F.col("to_id") == id)
        return found if kind is None else found.filter(F.col("kind") == kind)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, edges, self.sources, self.files)
