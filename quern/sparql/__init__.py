"""SPARQL 1.1 query and update language: lexer, syntax tree and parser."""

from quern.sparql.parser import SparqlSyntaxError, parse

__all__ = ["SparqlSyntaxError", "parse"]
