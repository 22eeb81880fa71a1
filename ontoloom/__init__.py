"""Ontology-to-graph projection and corpus preparation on Spark DataFrames."""
