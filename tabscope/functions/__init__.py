"""Column expressions and the few vectorised helpers the operators share."""
