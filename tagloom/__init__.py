"""tagloom: anchored sequence-comparison analytics, written as PySpark DataFrame jobs."""
