"""Operators for preparing large-scale training data.

Each module implements one operator as Spark jobs; ``queries`` registers one
query per operator.  Nothing outside this sub-package imports it.
"""
