"""Entity-resolution analytics expressed as Spark DataFrame plans."""
