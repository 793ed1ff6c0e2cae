"""Small documents with the difficult cases: nulls, empty and long texts, ties, copies, clashing column names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size long, score double, component string"


def words(t):
    return WORD.findall(t or "")


def documents():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(60)
    passage = prose(30)
    texts = [None, "", "   \n\t ", "one", "one two", "One Two", base, base, base.replace("w1 ", "w2 ", 1), base + " tail", passage, prose(20) + " " + passage + " " + prose(20)]
    texts += [prose(25) + " " + passage, prose(20_000), prose(40) + "\n" + prose(40), "x " * 300, "a b c d e f g h " * 12, "é à ü " + prose(30)]
    words60 = base.split()
    for k in range(12):  # near copies with an edit each
        w = list(words60)
        w[k * 4] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [prose(rng.randint(1, 80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, base))
    out = []
    for i, (d, t) in enumerate(rows):
        out.append((d, t, None if i % 11 == 3 else ["en", "de"][i % 2], None if i % 7 == 5 else f"s{i % 3}", 1, "clash", -1, 0.5, "clash"))
    return out


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
