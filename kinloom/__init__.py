"""kinloom: a PySpark engine for hierarchical, line-oriented genealogical data and tables of the same shape."""
