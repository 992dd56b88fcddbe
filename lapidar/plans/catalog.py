"""All core queries by name, and for each that SQL can express the SQL that gives the same rows."""

from __future__ import annotations

from lapidar.plans import annotation_queries, collection_queries, io_queries, pipeline, preparation_queries, problems, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (problems, text_queries, annotation_queries, collection_queries, io_queries, pipeline, preparation_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
