"""A PySpark-native engine for cataloguing and organising large file collections."""
