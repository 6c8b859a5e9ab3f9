"""Training-data operators: dedup, filtering, packing, mixing and search on Spark."""
