import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, start int, _row string"


def documents():
    """Small rows with copies, near copies, shared passages, nulls, empty and long texts, ties and odd characters."""
    rng = random.Random(5)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdeè"), ("bb", "ghijkñ"))}
    passage = " ".join(rng.choice(vocabulary["aa"]) for _ in range(60))
    rows = []
    for k in range(70):
        lang = "aa" if k % 3 else "bb"
        words = [rng.choice(vocabulary[lang]) for _ in range(rng.choice((3, 15, 25, 90, 400)))]
        text = " ".join(w + rng.choice(("", "", ",", ".\n" if rng.random() < 0.1 else "")) for w in words)
        if k % 7 == 0:
            text += "\n" + passage
        rows.append([k, text, lang, f"s{k % 4}" if k % 9 else "s0", len(text)])
    for k in range(10):
        base = rows[k * 5][1]
        rows.append([100 + k, base, "aa", "s0", 1])
        near = [w if rng.random() > 0.02 else "zz" for w in rows[k * 5 + 3][1].split(" ")]
        rows.append([120 + k, " ".join(near), None, "s1", 1])
    odd = ["", None, "   \n\t", "a", "one two three", "One TWO three", "x " * 500, "a  b   c", "<|endoftext|> and <s>x</s>", "mail bob.smith@mail.example.com now", "ip 10.0.0.1 and 999.1.1.1 or 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111111111111112", "call +1 (555) 010-9999.", "1234567", "\x02\x03 \x0b é́ 　 İ", "😀 👍🏽 中文字"]
    rows += [[200 + k, t, None if k % 2 else "aa", None if k % 3 else "s9", None] for k, t in enumerate(odd)]
    return [(*r, "clash", 7, "clash") for r in rows]


@pytest.fixture(scope="session")
def doc_rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
