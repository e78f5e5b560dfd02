"""Spark-native preprocessing of very large pyramidal images and of training corpora."""
