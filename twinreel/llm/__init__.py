"""Training-data operators: one module per operator, queries in ``entry``.

Nothing outside this folder imports it; it can be deleted as a whole.
"""
