"""quire: tabular and document analytics expressed as Spark DataFrame plans."""
