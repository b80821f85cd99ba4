"""All layout queries by name, and the DuckDB text that must give the same rows."""

from . import clustering, groundtruth, joins, raster, records

PARTS = (clustering, records, joins, raster, groundtruth)


def queries():
    return {name: run for part in PARTS for name, run in part.QUERIES.items()}


def oracle_sql():
    return {name: text for part in PARTS for name, text in part.SQL.items()}
