"""Training-data operators: one module an operator, all over plain DataFrames.

Nothing else in the library imports this subpackage.
"""
