"""Score analytics on Spark: DataFrame operators for musical scores and for event tables in general."""
