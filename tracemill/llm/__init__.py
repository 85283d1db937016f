"""Training-data operators: one module an operator, queries in ``queries``.

Nothing outside this subpackage imports it.
"""
