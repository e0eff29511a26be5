"""orefield: data mining and corpus preparation as Spark DataFrame operators."""
