"""Training-data operators: one module for each operator, their queries in ``queries``."""
