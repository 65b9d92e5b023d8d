"""sedimenta: content-addressed provenance analytics, expressed as Spark DataFrame plans."""
