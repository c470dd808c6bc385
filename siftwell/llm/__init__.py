"""Training-data operators: mixing, token ids, BPE, toxicity, counts, secrets, media, URLs, quality, near copies."""
