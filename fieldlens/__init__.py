"""Document-field analytics on Spark: fold, check, resolve, classify, measure and score field text."""
