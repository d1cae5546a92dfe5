"""All queries of this subpackage and their SQL."""

from pactlake.llm import exact_dedup, mixing, near_dup, packing, pii, quality, secrets, sharding, sketch, spelling, url_filter, warc, whitening

MODULES = (exact_dedup, mixing, near_dup, packing, pii, quality, secrets, sharding, sketch, spelling, url_filter, warc, whitening)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
