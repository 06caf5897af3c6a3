"""A PySpark-native engine for evaluating model outputs and analysing embeddings and text."""
