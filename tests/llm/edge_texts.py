"""Texts at the edges."""

#: Null, empty, white space, ties, repeated words, other scripts, a very long word and a long text.
EDGES = [None, "", " \n\t ", "a", "a", "A b C", "x " * 400, "ünï côdé 😀 日本語", "w" * 30_000, " ".join(f"w{i % 97}" for i in range(3000)), "one two three"]
