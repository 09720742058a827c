"""Pipeline stages: DataFrame in, DataFrame out."""
