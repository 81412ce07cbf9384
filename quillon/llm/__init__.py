"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it.  The registered queries are in
:mod:`quillon.llm.queries`; the operators have one module each.
"""
