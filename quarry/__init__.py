"""A document analytics engine on Spark: JSON filters, updates and pipelines compiled to DataFrame plans."""
