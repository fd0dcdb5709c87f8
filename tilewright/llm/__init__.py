"""Training-data operators: one module for each, plus `queries` with their registered forms."""
