"""DataFrame operators: ranking, graphs, intervals, as-of matching, references."""
