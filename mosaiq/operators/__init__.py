"""Pieces of the compiler: predicates, relations, order, aggregates, projections."""
