"""Several indicators compiled into one Spark plan."""
