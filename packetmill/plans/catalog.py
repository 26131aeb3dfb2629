"""All registered queries by name, in the order of the survey's sections."""

from __future__ import annotations

from functools import wraps

from packetmill.plans import alert_queries, data_queries, flow_queries, model_queries, stream_queries
from packetmill.session import prepare

_MODULES = [flow_queries, alert_queries, data_queries, model_queries, stream_queries]


def _prepared(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        return fn(prepare(spark), sf_dir)

    return run


def _entries():
    return {name: pair for module in _MODULES for name, pair in module.QUERIES.items()}


def queries():
    return {name: _prepared(fn) for name, (fn, _) in _entries().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _entries().items() if sql is not None}
