"""Documents with every odd case: nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, words string, `row` int, block long, rank int, `start` long"
EXTRA = (1, "x", "y", 3, 4, 5, 6)


def row(doc, text, source="s"):
    return (doc, text, None if doc is None else "en", source, None if text is None else len(text), *EXTRA)


def documents(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = " ".join(r.choice(vocabulary) for _ in range(30))
    out = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if k % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = shared.split()
        text = r.choice([" ", "  ", "\n", "\t "]).join(words)
        out.append(row(k * 3, text, None if k % 11 == 0 else f"s{k % 4}"))
    out += [row(1000 + k, out[k][1], "s1") for k in range(20)]  # exact copies
    out += [row(2000 + k, (out[k + 40][1] or "") + " tail", "s2") for k in range(20)]  # near copies
    out += [row(5, None), row(7, ""), row(8, " \t\n\x0b "), row(None, "a b c"), row(None, shared), row(None, None)]
    out += [row(9, "one two three " + shared)] * 3  # repeated rows
    out += [row(10, "é ü 漢字 \U0001f600 x y z"), row(11, "A B C a b c"), row(12, "word"), row(13, "two words")]
    out += [row(4000, " ".join(r.choice(vocabulary) for _ in range(40_000)))]  # very long
    r.shuffle(out)
    return out


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
