"""Spark-native sectioniser for long semi-structured documents."""
