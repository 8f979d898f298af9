"""hopframe: property-graph analytics as Spark DataFrame joins."""

from hopframe.model import EdgeTable, PropertyGraph
from hopframe.operators.frontier import Frontier

__all__ = ["EdgeTable", "Frontier", "PropertyGraph"]
