"""leafstack: passage retrieval over a corpus of books and documents, planned as Spark DataFrames."""
