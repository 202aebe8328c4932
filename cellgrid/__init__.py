"""A PySpark engine for data on a discrete global grid."""
