"""A Spark-native engine for Earth-observation catalogues, composites and footprints."""
