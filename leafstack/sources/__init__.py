"""Readers of books and documents, and the Parquet tables that hold what was ingested."""
