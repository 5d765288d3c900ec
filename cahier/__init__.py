"""cahier: question answering over large collections of tender documents, as PySpark jobs."""
