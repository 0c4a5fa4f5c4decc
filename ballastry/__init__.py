"""A PySpark-native engine for portfolio analytics on price panels."""
