"""Operators of a training-data pipeline over documents and web pages.

Every module holds one operator and, at its end, the registered query that
applies it to a whole table. Nothing else in the library imports this package.
"""
