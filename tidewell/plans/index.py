"""All queries and their SQL."""

from tidewell.plans import builds, catalogue, curating, files, reports, scoring  # noqa: F401

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL
