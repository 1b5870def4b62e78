"""Spark-native product intelligence: catalog analytics, document extraction and catalog ETL on DataFrames."""
