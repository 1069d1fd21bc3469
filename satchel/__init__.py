"""Bag analytics on Spark: set distances, clusterers, validity indices and population operators as DataFrame plans."""
