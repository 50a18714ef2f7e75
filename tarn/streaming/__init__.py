"""Nothing here streams: every operator is a batch query. Scores of new samples are appended as new partitions."""
