"""Operators for building language-model training corpora.

Nothing outside this package imports it; `__spark_entry__.py` adds its queries only where it is present.
"""
