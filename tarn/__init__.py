"""A PySpark-native analytics engine: dialect SQL, schema algebra and migrations on DataFrames."""
