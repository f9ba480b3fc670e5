"""Training-data operators: text and vector jobs over document-scale tables."""
