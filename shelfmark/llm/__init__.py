"""Operators for training-data pipelines: one module for each operator, and `queries` that registers them.

Nothing outside this subpackage imports it; `__spark_entry__` adds its queries when it is present.
"""
