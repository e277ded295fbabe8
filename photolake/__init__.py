"""photolake: PySpark jobs over very large photo and video catalogs."""
