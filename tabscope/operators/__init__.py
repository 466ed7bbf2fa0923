"""The operators, one module per family."""
