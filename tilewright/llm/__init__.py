"""Operators for the preparation of language-model training data.

Each module holds one operator with its general interface and the query ``opN_<name>`` that
applies it to a whole table; ``registry`` gathers the queries and their SQL.
"""
