"""maskframe: label spaces, masks and metrics of image segmentation as Spark DataFrames."""
