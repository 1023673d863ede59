"""Preparation of training corpora: thirteen operators over documents, pages, conversations, embeddings and benchmarks.

Nothing else in the library imports this subpackage. Operators take DataFrames; ``queries`` binds them to the tables.
"""
