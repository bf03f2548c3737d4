"""All registered queries: name -> (job, SQL or None)."""

from . import answer_queries, document_queries, graph_queries

CATALOG = {**document_queries.QUERIES, **graph_queries.QUERIES, **answer_queries.QUERIES}
