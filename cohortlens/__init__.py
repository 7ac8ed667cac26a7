"""Entity-by-year panel analytics written as Spark DataFrame transformations."""
