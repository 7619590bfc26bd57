"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; ``queries`` holds the thin
registered queries, every other module one operator with its own interface.
"""
