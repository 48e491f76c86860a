"""Window-search analytics over multidimensional arrays and series, on Spark."""
