"""Sample texts and columns for the tests of this folder."""

import random

#: Columns whose names the operators use inside.
CLASHING = (
    "row", "digest", "size", "u", "path", "node", "word", "statistic", "key", "text_key", "block", "n", "kept", "uid", "kinds", "file", "ids", "_id",
    "trusted", "target", "copies", "shard", "slot", "leader")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["tha", "ren", "ing", "ou", "ster", "lo", "mi", "é", "ß", "qu"]
    out = []
    for i in range(words):
        out.append("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.12:
            out[-1] += "." if rng.random() < 0.7 else ".\n"
    return " ".join(out)
