"""Relational operators: each is one plan, or a fixed number of passes."""
