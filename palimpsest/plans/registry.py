"""All queries of the core, by name, and the SQL they are held against."""

from palimpsest.plans import ingest, injection, integrity, maintenance, recall, search, store, streams

MODULES = [search, recall, injection, ingest, maintenance, streams, integrity, store]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
FLAGSHIP = "search"
