"""Analytics over collections of raster image files, on PySpark."""
