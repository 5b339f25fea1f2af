"""Screens as data: their nodes and JSON form, what they need of the data, and their translation to columns."""
