"""Operators for preparing language-model training data.

Self-contained: nothing outside this folder (and ``corpus_pipeline.py`` at
the repository top) imports it.  One module per operator; ``queries``
registers the thin ``opN_<name>`` queries and their SQL.
"""
