"""marl: a PySpark-native analytics and data-mining engine."""
