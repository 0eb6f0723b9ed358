"""Streams: progress of documents, and the chain of stages over documents as they land."""
