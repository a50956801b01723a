"""Operators of a training-data pipeline over a ``documents`` table.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
