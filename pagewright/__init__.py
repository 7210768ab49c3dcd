"""Page-to-Markdown analytics on Spark: DataFrame operators over tables of raw web pages."""
