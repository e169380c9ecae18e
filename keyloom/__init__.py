"""A PySpark engine for keyed data structures and their command logs."""
