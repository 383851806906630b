"""The queries checked against SQL on the given tables."""

from __future__ import annotations

import functools

from ..session import steady_unions
from . import answers, records, reports, retrieval

MODULES = [retrieval, records, answers, reports]


def all_queries() -> dict:
    return {name: _steady(run) for module in MODULES for name, run in module.QUERIES.items()}


def _steady(run):
    @functools.wraps(run)
    def steady(spark, sf_dir):
        steady_unions(spark)
        return run(spark, sf_dir)

    return steady


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
