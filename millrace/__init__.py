"""millrace: a relational warehouse engine expressed in PySpark."""
