"""Code-graph analytics and corpus preparation on PySpark."""
