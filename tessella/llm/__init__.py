"""Training-data operators: search, dedup, rules, taggers, tokenizers, language models, packing."""
