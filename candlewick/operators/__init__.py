"""Operators over bar tables: resampling, screening, results."""
