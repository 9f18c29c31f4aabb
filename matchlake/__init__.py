"""matchlake: point-in-time match analytics and data processing, declared as PySpark plans."""
