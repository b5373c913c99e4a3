"""octetlake: Spark-native analytics over large collections of binary images and byte blobs."""
