"""Queries over the sample tables, each with SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.fixtures import LIT_NOW, Tables, with_ctes
from geoloom.session import ship_package

QUERIES = {}
ORACLE = {}
NOW_SQL = f"timestamp '{LIT_NOW}'"


def now():
    return F.lit(LIT_NOW).cast("timestamp")


def stamp(name: str):
    """Timestamps are compared as text."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def query(oracle: str | None = None):
    """Register a function of `Tables` under its own name."""
    def register(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(ship_package(spark), sf_dir))
        if oracle is not None:
            ORACLE[name] = with_ctes(oracle)
        return fn
    return register
