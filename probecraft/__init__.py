"""A PySpark-native engine for evidence ablation over document collections."""
