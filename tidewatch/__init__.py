"""Semantic alerting over crawled pages, expressed as Spark DataFrame jobs."""
