"""Training-data operators: quality rules, near-duplicates, decontamination, secrets, tokenizers and others.

Nothing outside this folder imports it.  ``queries`` holds the registered queries, ``oracles`` their SQL.
"""
