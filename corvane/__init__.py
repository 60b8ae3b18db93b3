"""Retrieval analytics over document collections, written with the Spark DataFrame API."""
