"""Collects queries: a Spark function over the views, and the oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from checks.views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def check(name: str, covers: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query. `covers` names the survey rows, `views` the CTEs the SQL uses."""

    def register(build):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times
            return build(Views(spark, sf_dir))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return build

    return register
