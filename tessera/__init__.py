"""A multi-model analytics engine on PySpark: documents, graphs, vectors and text as DataFrames."""
