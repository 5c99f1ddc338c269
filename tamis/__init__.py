"""tamis: a PySpark-native engine that sieves large event streams down to the records that matter."""
