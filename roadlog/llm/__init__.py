"""Operators for training-data corpora. Nothing else in the library imports this subpackage.

One module per operator; `queries` registers the op queries and their SQL.
"""
