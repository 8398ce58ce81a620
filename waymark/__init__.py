"""waymark: Spark-native building, checking and querying of a directory of places."""
