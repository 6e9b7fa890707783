"""Analytics over document graphs, written with the Spark DataFrame API."""
