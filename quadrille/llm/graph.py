"""Connected components, with tables of the shared folder between the rounds; joins on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadrille.llm.common import materialise
from quadrille.operators import graph
from quadrille.operators.graph import HOT, SALTS, join_on_hot

__all__ = ["HOT", "SALTS", "components", "join_on_hot"]


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v); nothing but emptiness and hot keys comes to the driver."""
    return graph.components(edges, materialise)
