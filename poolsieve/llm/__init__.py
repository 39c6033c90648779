"""Operators for preparing text corpora for language-model training.

Nothing else in the library imports this subpackage.  Every operator module
offers a general function over DataFrames; :mod:`poolsieve.llm.queries` wraps
them into the registered ``opN_*`` queries.
"""
