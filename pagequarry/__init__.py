"""Page extraction on Spark: tables of crawled pages in, tables of structured results out."""

__version__ = "0.1.0"
