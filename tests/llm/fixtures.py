"""Small tables with what real ones hold: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, _id string, id string, score double, start bigint"


def words(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(3, 160)) for _ in range(n)]
    texts = list(base)
    for t in base[:20]:
        w = t.split()
        texts.append(t)  # copy
        texts.append(t.replace(" ", "  \t") + "\n")  # copy but for white space
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))  # near copy
    passage = words(rng, 60)
    for t in base[20:32]:
        texts.append(t + "\n" + passage + "\n" + words(rng, 20))  # a passage in many documents
    long = words(rng, 9000)
    texts += [long, long[: len(long) // 2] + " x " + long[len(long) // 2 :], "", None, " \n\t ", "a", "a", "ab " * 400, "é" * 500, "日本語 " * 80, "<|endoftext|> x", "İΣ ς́ \x1c \x85 q"]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", len(t or ""), True, "z", "y", 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "null id text here for all of us", "en", "s", 1, False, "z", "y", 0.5, 7)]
    return spark.createDataFrame(rows, KIND).repartition(5), rows


def empty(spark):
    return spark.createDataFrame([], KIND)
