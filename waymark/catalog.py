"""The library's queries: name -> callable, name -> DuckDB SQL."""

from waymark.plans.registry import ORACLE_SQL, QUERIES, load

load()

FLAGSHIP = "AG4_vote_fusion"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
