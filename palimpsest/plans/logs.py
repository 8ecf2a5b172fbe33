"""A logger, and figures of a run that the executors gather while it runs."""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import Column, DataFrame, Observation


def logger(name: str = "palimpsest", file: str | None = None) -> logging.Logger:
    """A logger of a name, made once: all messages on the driver, errors only in Python workers, to standard output and a file if named."""
    found = logging.getLogger(name)
    if found.handlers:
        return found
    form = logging.Formatter("[%(asctime)s] %(name)s %(levelname)s: %(message)s", "%Y/%m/%d %H:%M:%S")
    for handler in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(file, encoding="utf-8")] if file else [])]:
        handler.setFormatter(form)
        found.addHandler(handler)
    found.setLevel(logging.ERROR if "SPARK_PYTHON_WORKER" in os.environ or "PYTHON_WORKER_FACTORY_SECRET" in os.environ else logging.DEBUG)
    found.propagate = False
    return found


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """The DataFrame, and aggregates over it that are there once an action has run: no pass of their own is made."""
    seen = Observation()
    return df.observe(seen, *[v.alias(k) for k, v in figures.items()]), seen
