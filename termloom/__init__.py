"""Term extraction and corpus statistics as PySpark DataFrame plans."""
