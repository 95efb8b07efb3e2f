"""Record linkage, approximate text matching and span analytics as Spark DataFrame operators."""
