"""Training-data operators: ten methods, one module each.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
