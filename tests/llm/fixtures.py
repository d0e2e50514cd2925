"""Small inputs with everything awkward: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, shard string, block string, "
          "n_words string, ids string, size string, links string")


def prose(seed: int, words: int, vocabulary: int = 60) -> str:
    r = random.Random(seed)
    names = ["".join(random.Random(i).choice("bcdfglmnprst") + random.Random(i * 7 + 1).choice("aeiou") for _ in range(1 + i % 3)) + str(i % 7)
             for i in range(vocabulary)]
    return " ".join(r.choice(names) + ("." if r.random() < 0.1 else "") for _ in range(words))


def rows() -> list[tuple]:
    texts = [prose(i, 30 + 7 * i) for i in range(30)]
    texts += [texts[3], texts[3], texts[4] + " Tail", "", None, " \t\n ", "one", "É ẞ ✓ 日本", "a\n\n\nb  c", "x" * 3000, prose(99, 5000)]
    texts += [texts[5].upper(), "idiot " * 40, "line one is here\nline one is here\nother\n" * 5, "\x00 \x1c odd", "▁ mark"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4]) for i, t in enumerate(texts)]
    out += [out[7], out[7], (None, "no id here", "en", "s1"), (None, None, None, None)]
    return [(*r, None if r[1] is None else len(r[1]), *["x"] * 7) for r in out]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
