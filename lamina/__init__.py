"""lamina: layered data-quality, feature and corpus operators on PySpark DataFrames."""
