"""Operators for preparing training text: one module for each, `queries` for the registered ones."""
