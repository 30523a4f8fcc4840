"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from quillet.llm import pipeline
from quillet.llm import queries as q

QUERIES = {**q.QUERIES, "pipeline": pipeline.run}
ORACLE_SQL = {**q.ORACLE_SQL, **({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})}
