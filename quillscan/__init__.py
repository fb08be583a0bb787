"""quillscan: a PySpark-native engine for content forensics and compliance."""
