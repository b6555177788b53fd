"""Catalog search, context assembly and conversation-state jobs on Spark."""
