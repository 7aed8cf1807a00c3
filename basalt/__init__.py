"""basalt: versioned, content-addressed record catalogs on PySpark."""
