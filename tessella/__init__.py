"""tessella: corpus curation and evaluation analytics expressed as Spark DataFrame plans."""
