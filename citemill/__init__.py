"""citemill: a Spark-native analytics library for bibliographic and text corpora."""
