"""Operations of a training-data pipeline over the documents and embeddings tables.

Nothing else in the library imports this subpackage; it imports only general
session helpers. ``queries`` registers one query per operator.
"""
