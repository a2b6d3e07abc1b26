"""Document retrieval and corpus preparation expressed as Spark DataFrame plans."""
