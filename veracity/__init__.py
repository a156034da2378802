"""Data-quality profiling, validation and cleaning as Spark DataFrame plans."""
