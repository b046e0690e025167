"""Registered queries: name -> callable, and the SQL that says the same."""

from __future__ import annotations

from ..sources.records import records
from . import census, cohorts, enforcement, fact_queries, file_queries, glued_queries, insights, link_queries, live_queries, path_census, rules, session_queries, shell_queries, table_queries, transcript_queries, work_patterns

QUERIES: dict = {**session_queries.QUERIES, **table_queries.QUERIES, **census.QUERIES, **insights.QUERIES, **transcript_queries.QUERIES, **live_queries.QUERIES, **shell_queries.QUERIES, **work_patterns.QUERIES, **path_census.QUERIES, **link_queries.QUERIES, **cohorts.QUERIES, **enforcement.QUERIES, **glued_queries.QUERIES, **file_queries.QUERIES, **fact_queries.QUERIES, **{n: lambda spark, sf_dir, f=f: f(records(spark, sf_dir)) for n, f in rules.QUERIES.items()}}
ORACLE: dict = {**session_queries.ORACLE, **table_queries.ORACLE, **rules.ORACLE, **census.ORACLE, **insights.ORACLE, **transcript_queries.ORACLE, **live_queries.ORACLE, **shell_queries.ORACLE, **work_patterns.ORACLE, **path_census.ORACLE, **link_queries.ORACLE, **cohorts.ORACLE, **enforcement.ORACLE, **glued_queries.ORACLE, **file_queries.ORACLE, **fact_queries.ORACLE}
