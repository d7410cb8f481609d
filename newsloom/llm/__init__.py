"""Operators of a training-data pipeline over ``documents``, ``pages``, ``labels`` and ``conversations``.

Nothing outside this folder imports it.
"""
