"""gridloom: Spark-native analytics for area-level electricity load."""
