"""scholion: a PySpark-native engine for scholarly-record and document corpora."""
