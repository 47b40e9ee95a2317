"""Semantic queries, ontologies, rules and constraints over Spark DataFrames."""
