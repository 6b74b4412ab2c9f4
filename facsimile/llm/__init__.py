"""Training-data pipeline operators (one module per operator).

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""
