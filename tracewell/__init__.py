"""tracewell: a Spark-native engine for analysing structured evidence."""
