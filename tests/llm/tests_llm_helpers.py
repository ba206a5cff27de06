def shingles(text, k):
    """The distinct k-word shingles, or the whole sequence of a shorter text."""
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
