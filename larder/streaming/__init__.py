"""Structured Streaming forms of the ledger jobs; the batch forms are their reference."""
