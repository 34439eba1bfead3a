"""Price-index jobs on Spark: DataFrame in, DataFrame out."""
