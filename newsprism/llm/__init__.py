"""Operators for training-data pipelines over documents, pages and embeddings.

One module per operator; :mod:`newsprism.llm.queries` registers one query per operator. Nothing
outside this folder and ``corpus_pipeline.py`` imports it.
"""
