"""folioscope: document-analysis evaluation on Spark."""
