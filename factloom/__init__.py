"""A PySpark-native engine for document facts: pages, facts, entities and their reconciliation."""
