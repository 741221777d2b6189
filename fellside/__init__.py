"""fellside: terrain-raster analytics, grid routing and tour planning on Spark."""
