"""graphloom: graph analytics on Spark DataFrames."""

from graphloom.graph import Graph

__all__ = ["Graph"]
