"""Tessera: entity intelligence and training-data operators as Spark jobs."""
