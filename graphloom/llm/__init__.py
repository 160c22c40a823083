"""Operators for preparing training text.  Nothing else in graphloom imports this package."""
