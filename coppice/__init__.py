"""Coppice: Spark-native table operators for post-training rollouts and chat data."""
