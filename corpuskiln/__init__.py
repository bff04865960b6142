"""corpuskiln: a Spark-native engine for preparing and auditing instruction and text corpora."""
