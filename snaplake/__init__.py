"""snaplake: snapshot-to-insight analytics as PySpark DataFrame operators."""
