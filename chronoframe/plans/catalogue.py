"""Every query of the engine by name, with the SQL that gives the same rows."""

from chronoframe.plans import media_queries, planner_queries, report_queries, signal_queries, store_queries, text_queries

_PARTS = (signal_queries, planner_queries, text_queries, media_queries, report_queries, store_queries)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in _PARTS:
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
