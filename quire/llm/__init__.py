"""Training-data operators: licence scan, mixing, quality, near duplicates, vector search,
fingerprints, token counts, toxicity, repeated passages, byte-pair encoding, vector codes, line deduplication and the
conversation prefix trie.

Nothing outside this subpackage imports it.
"""
