"""PySpark toolkit for irregular, multi-band time series and the classifiers trained on them."""
