"""pagelode: retrieval and corpus processing over tables of pages and documents, on PySpark."""
