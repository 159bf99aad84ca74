"""Column-level building blocks: scalar and array expressions, small matrices, distribution tails."""
