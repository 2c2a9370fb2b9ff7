"""Small-matrix algebra, probability distributions and column expressions."""
