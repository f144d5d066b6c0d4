"""Registered queries: name -> callable(spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from postern.plans.workspace import Workspace

QUERIES: dict[str, Callable] = {}


def query(name: str):
    """Register ``fn(workspace) -> DataFrame`` under a name."""

    def wrap(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Workspace(spark, sf_dir))
        return fn

    return wrap
