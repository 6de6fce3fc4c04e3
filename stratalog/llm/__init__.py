"""Training-data operators: thirteen Spark jobs over documents, pages, embeddings and conversations.

Nothing else in the library imports this subpackage.
"""
