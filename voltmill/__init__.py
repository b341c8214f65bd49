"""voltmill: a Spark-native analytics engine for charging-network data."""
