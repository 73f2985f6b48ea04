"""fenmark: habitat, raster and time-series analytics expressed as Spark DataFrame plans."""
