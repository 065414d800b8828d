"""millrace: lakehouse and corpus operators written as Spark DataFrame plans."""
