"""Training runs, the registry that keeps them, and the reports made from it."""
