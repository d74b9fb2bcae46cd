"""factloom: a PySpark-native program-analysis and data-processing engine."""
