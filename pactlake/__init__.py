"""Data contracts on Spark: profile, infer, validate, compare, attribute and report on tables of any size."""
