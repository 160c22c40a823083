"""Timed trials of a kernel on a graph that has been read and written before."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.graph import Graph


def run_trials(graph: Graph, kernel: Callable[[Graph], DataFrame], trials: int = 16, verify: Callable[[DataFrame], bool] | None = None) -> dict:
    """``seconds`` of each trial, their ``mean``, and whether every result was ``right`` (None without ``verify``).

    The graph's edges are written and counted first; a trial ends when a sink has taken every row.
    """
    graph = graph.cache()
    graph.by_src().count()
    seconds, right = [], None
    for _ in range(trials):
        began = time.perf_counter()
        result = kernel(graph)
        result.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
        if verify:
            right = verify(result) and right is not False
    return {"seconds": seconds, "mean": sum(seconds) / max(1, len(seconds)), "right": right}
