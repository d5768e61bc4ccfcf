"""Payment reconciliation and table cleaning as Spark jobs: DataFrame in, DataFrame out."""
