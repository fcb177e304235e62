"""Operators for preparing language-model training data on Spark.

Nothing else in the library imports this package. Its registered queries are
in :mod:`almagest.llm.queries`; ``corpus_pipeline.py`` at the repository top
chains five of the operators.
"""
