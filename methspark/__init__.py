"""Spark-native methylation analytics: every public function takes and returns DataFrames."""
