"""Training-data operators: dedup, similarity, extraction, tokens, neighbours, chats, mixing, classifiers."""
