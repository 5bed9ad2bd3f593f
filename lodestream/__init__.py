"""Signal, identity and ownership analytics expressed as Spark DataFrame plans."""
