"""Small documents with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket long, row string, W1 long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, n: int) -> str:
    words = ["the", "of", "river", "Stone", "lamp", "éclair", "über", "niño", "cloud", "paper", "train", "quick", "brown", "night", "garden", "iron", "glass", "seven"]
    out = []
    for i in range(n):
        w = rng.choice(words) + rng.choice(["", "s", "ing", "ly", "er"])
        out.append(w + ("." if i % 11 == 10 else "") + ("\n" if i % 17 == 16 else ""))
    return " ".join(out)


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    base = sentence(rng, 240)
    words = base.split(" ")
    near = [" ".join("changed" if rng.random() < p else w for w in words) for p in (0.01, 0.02, 0.03, 0.05, 0.3)]
    passage = sentence(rng, 70)
    out: list[tuple[int | None, str | None]] = [(i, sentence(rng, rng.randrange(1, 160))) for i in range(1, 25)]
    out += [(100, base), (101, base), (102, base.upper())] + [(110 + i, t) for i, t in enumerate(near)]
    out += [(200 + i, f"{sentence(rng, 20)} {passage} {sentence(rng, 30)}") for i in range(5)]
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"), (305, "One two"), (306, "    x")]
    out += [(1, out[0][1]), (1, out[0][1]), (None, base), (None, None), (400, sentence(rng, 6000)), (401, "a " * 400), (402, "a " * 300)]
    return out


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", "s", len(t or ""), 7, 7, "r", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
