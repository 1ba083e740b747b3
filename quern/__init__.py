"""Text retrieval, chunking and evaluation expressed as Spark DataFrame plans."""
