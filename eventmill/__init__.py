"""Spark operators that turn crawled pages into a clean event calendar."""
