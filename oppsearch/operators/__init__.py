"""DataFrame operators: load, search, vectors, lexical search, turns, context, evaluation."""
