"""veritrove: verified-retrieval analytics expressed as PySpark DataFrame work."""
