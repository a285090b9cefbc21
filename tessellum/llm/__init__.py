"""Training-data operators: near-dedup, language ID, LM scoring, licences, tokens, mixing, URLs, toxicity, fingerprints,
manifests, byte-level tokens, collocations.

Nothing outside this subpackage imports it.
"""
