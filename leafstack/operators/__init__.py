"""Relational operators over pages, chunks, postings and vectors."""
