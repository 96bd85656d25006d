"""Training-data operators.

Each module holds one operator with its own general interface; ``queries``
binds them to the driver's tables. Nothing outside this package imports it.
"""
