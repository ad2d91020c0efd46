"""Operators for preparing language-model training data.

Nothing else in the library imports this package; ``__spark_entry__`` registers
its queries only when it can be imported.
"""
