"""Dataset-curation and model-evaluation operators as Spark DataFrame transformations."""
