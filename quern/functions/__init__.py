"""SPARQL functions, operators and aggregates as Spark columns."""
