"""DataFrame operators: matching, duplicates, metrics, meters, augmentation, batching, decoding."""
