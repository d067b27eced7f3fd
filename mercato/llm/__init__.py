"""Operators for large training corpora (see README, "Training-data operators").

Nothing outside this package imports it; ``queries.py`` holds the driver's
queries and their SQL.
"""
