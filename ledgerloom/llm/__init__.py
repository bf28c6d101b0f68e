"""Operators for building training data; each module holds one, `queries` binds them to the test tables."""
