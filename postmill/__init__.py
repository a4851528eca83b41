"""postmill: a PySpark-native engine for collections of job postings."""

__version__ = "0.1.0"
