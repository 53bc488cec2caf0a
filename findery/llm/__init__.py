"""Training-data operators: near-duplicates, tokens, personal data, shards, leaks, licences, quality, language.

Nothing else in the library imports this subpackage.  Every operator takes a DataFrame with the
columns of ``documents`` (others may be there too) and returns a DataFrame; the thin queries in
``findery.llm.queries`` derive the checked digests from those results.
"""
