"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from functools import cache

from ..session import apply_sql_defaults, drop_unread, staged_tables
from . import metric_catalog, pipeline_catalog


@cache
def _build():
    q, o = {}, {}
    for mod in (metric_catalog, pipeline_catalog):
        mq, mo = mod.build()
        q.update(mq)
        o.update(mo)
    return q, o


def _with_defaults(fn):
    def run(spark, sf_dir):
        apply_sql_defaults(spark)
        before = staged_tables()
        return drop_unread(fn(spark, sf_dir), before)

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def queries():
    return {k: _with_defaults(v) for k, v in _build()[0].items()}


def oracle_sql():
    return dict(_build()[1])
