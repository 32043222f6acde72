"""Training-data operators: language models, extraction, search, near copies, packing, tokens, filters."""
