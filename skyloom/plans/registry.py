"""All queries of the sky-catalog engine and their SQL."""

from skyloom.plans import sky, survey, waves

FLAGSHIP = "cutsky_single"
QUERIES = sky.QUERIES | survey.QUERIES | waves.QUERIES
ORACLE_SQL = sky.ORACLE_SQL | survey.ORACLE_SQL | waves.ORACLE_SQL
