"""tallyspark: public-spending analytics operators written as PySpark DataFrame code."""
