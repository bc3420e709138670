"""Operators for preparing training text: each module holds one operator; queries.py applies them to the tables."""
