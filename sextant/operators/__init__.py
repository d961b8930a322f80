"""Query operators over collections.

A collection is a DataFrame with columns collection, id, row and vector (any of
row and vector may be missing) and one column per attribute.
"""
