"""Log search and corpus preparation on PySpark."""
