"""Queries over the given tables, and the SQL that checks each of them."""

from pageloom.workload import content_queries, crawl_queries, rule_queries, url_queries

MODULES = (url_queries, content_queries, crawl_queries, rule_queries)
