"""Source-tree property graphs on PySpark."""
