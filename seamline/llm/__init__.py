"""Operators for preparing training text: ten operators and the queries that apply them."""
