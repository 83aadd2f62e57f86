import pytest


@pytest.fixture(scope="session")
def documents():
    """Texts with copies, near copies, shared passages, symbols, special tokens, odd white space, nulls and long words."""
    import random

    random.seed(5)
    syllables = "an re the tion é ou ing st ble".split()
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = [(None, "a b c d e f g h i j k l m n o"), (3, "A b c d e f g h i j k l m n o"), (3, "a b c d e f g h i j k l m n o"), (3, "a b c d e f g h i j k l m n o")]
    rows += [(1, None), (2, ""), (4, "a b"), (6, "A B"), (7, " \t\x0b\n"), (8, "x" * 3000), (9, "z " * 400), (-5, "b c d e f g h i j k l m n o"), (10, "<|endoftext|>I'll don't <|startoftext|>　\x1c\x85\r\n  ok")]
    base = [word() for _ in range(80)]
    for d in range(100, 160):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(80)] = word()
        rows.append((d, " ".join(w)))
    for d in range(160, 220):
        body = " ".join(word() for _ in range(random.randint(1, 90)))
        rows.append((d, f"{body}\n{passage}\n{word()}." if d % 3 == 0 else f"{body}!!\nReleased under the MIT License.\n{body}"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The texts as a table with further columns, some of whose names clash with those that operators use."""
    rows = [(d, t, "en", "s", len(t or ""), 1, "k") for d, t in documents]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, words string").repartition(5)
