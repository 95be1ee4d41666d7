"""Document segmentation and corpus preparation on Spark."""
