"""Operators of a training-data pipeline.

Nothing outside this folder imports it.  Each module holds one operator with its own general
interface; ``queries`` registers the thin queries that apply the operators to whole tables.
"""
