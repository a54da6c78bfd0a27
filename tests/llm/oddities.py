"""Documents that every corpus operator has to cope with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, fp long, score double, starts string, shard long, target string"


def prose(rng, n):
    syllables = ["the", "on", "er", "ti", "sh", "ou", "re", "an", "wh", "es", "ly", "ble", "nd", "ç", "ö"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def odd_rows():
    """Documents with nulls, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(5)
    shared, line = prose(rng, 60), " ".join(prose(rng, 9)) + " a line of boilerplate"
    base = prose(rng, 200)
    near = list(base)
    near[100] = "changed"
    long = prose(rng, 30_000)
    texts = [None, "", "   \n\t ", "one", "One", "two words", " ".join(base), " ".join(near), " ".join(base), " ".join(prose(rng, 40) + shared + prose(rng, 40)),
             " ".join(prose(rng, 10) + shared + prose(rng, 10)), "\n".join([line, "x", line.upper(), " ".join(prose(rng, 30))]), f"{line}\n\n{line}",
             f"  {line}\t\n" + " ".join(prose(rng, 25)), " ".join(long), " ".join(long[5000:5100] + ["new"] + long[5100:5200]), "a " * 500, "a b " * 60,
             "   nbsp \x1c words \x85", "0123456789" * 40, "Ünïcode ÀÉ " * 30]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, None), (None, " ".join(shared)), (None, f"{line}\nend"), (3, "one"), (3, "one"), (6, " ".join(prose(rng, 30))), (50, " ".join(shared + shared))]
    rng.shuffle(rows)
    return rows
