"""Spark-native preparation of clinical free text: parsing, linkage, de-identification, release."""
