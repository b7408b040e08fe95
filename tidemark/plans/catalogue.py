"""All registered queries of the library, with the SQL that each is held against."""

from __future__ import annotations

from tidemark.plans import companies, following, markets, questions, runs, texts, trends

PARTS = (trends, texts, markets, companies, runs, following, questions)
QUERIES = {name: query for part in PARTS for name, query in part.R.queries.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.R.sql.items()}
