"""Record linkage across sources of noisy business records, as Spark DataFrame plans."""
