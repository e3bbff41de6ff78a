"""A PySpark-native signal-intelligence engine: text, scoring, clustering and event operators on DataFrames."""
