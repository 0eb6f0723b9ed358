"""Schemas, facts derived from the driver's tables, and queries with their SQL."""
