"""Column builders: predicates, text identity, vectors, temporal frames."""
