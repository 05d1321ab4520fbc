"""Stages that one query uses several times.  Every query starts without any, so each does its own work."""

from functools import wraps

_STAGES = {}


def stage(spark, sf_dir, name, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def own_work(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        _STAGES.clear()
        return fn(spark, sf_dir)

    return run
