"""Training-data operators: one module for each operator, and ``registry`` with their queries."""
