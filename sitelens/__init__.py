"""sitelens: a PySpark-native evidence-analytics engine for early-stage site screening."""
