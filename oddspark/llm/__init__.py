"""Operations of a training-data pipeline: ten operators over documents, embeddings and conversations.

Nothing else in the library imports this subpackage.
"""
