"""A PySpark analytics engine for libraries of generated media."""
