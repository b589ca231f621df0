"""All queries of the training-data operators, by name, and the SQL they are held against."""

from palimpsest.llm import corpus, duplicates, privacy, rankings, segmentation, similar_vectors, splitting

MODULES = [splitting, similar_vectors, privacy, duplicates, rankings, corpus, segmentation]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
