"""quern: SPARQL 1.1 queries and standing rules compiled to Spark DataFrame plans."""
