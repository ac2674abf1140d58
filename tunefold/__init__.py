"""Point-process and tuning-curve analytics as PySpark DataFrame operators."""
