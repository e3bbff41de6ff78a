"""DataFrame operators: deduplication, upserts with retention, ranking and summaries."""
