"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it; ``sextant.llm.queries`` binds the
operators to the ``documents`` table.
"""
