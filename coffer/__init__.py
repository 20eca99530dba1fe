"""A Spark-native engine for transaction-ledger analytics and training-data preparation."""
