"""A PySpark-native analytics engine for multi-tenant document collections."""
