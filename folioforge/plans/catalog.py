"""All registered queries of the core and their SQL."""

from __future__ import annotations

from folioforge.plans import clean, fields, files, geo, ingest, records, series

MODULES = [records, series, fields, geo, clean, ingest, files]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "city_share_ci"
