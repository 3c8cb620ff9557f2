"""Small awkward tables: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    passage = sentence(rng, 40)
    texts = [None, "", "  \n\t ", "one", "two words", "é à ü 漢字  x", "a\nb\na\nb\n\na", "%%% $$$ | & < > #" * 20]
    for k in range(n):
        t = sentence(rng, rng.randrange(5, 160))
        if k % 5 == 0:
            t = f"{t}\n{passage}\n{sentence(rng, 20)}"
        texts.append(t)
    base = sentence(rng, 120, 5000)
    for k in range(12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [texts[9]] * 6 + [base, base]  # copies
    texts.append(sentence(rng, 30_000, 50_000))  # very long
    texts.append("same " * 500)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "a", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
