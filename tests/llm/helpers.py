"""Fixtures and plain reference computations for the text operators."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Extra columns whose names operators use inside.
NAMES = ("key", "tie", "packed", "fp", "digest", "label", "core", "part", "_f", "_p", "_n", "_k", "_t", "_void", "_kept",
         "file", "pos", "node", "node_", "kept", "void", "bucket", "root", "a.b", "c`d")
EXTRA = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def frame(spark, rows, partitions=3):
    """documents with clashing extra columns from (doc_id, text) pairs."""
    full = [(i, t, "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t), *["x"] * len(NAMES))
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def corpus(seed, n=40, vocabulary=12, longest=60):
    """Random texts with copies, shared passages, repeats, odd white space, empty and null texts, repeated rows."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(vocabulary)] + ["é", "日本", "ab"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for _ in range(n):
        kind = rng.random()
        own = " ".join(rng.choice(words) for _ in range(rng.randint(0, longest)))
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.45:
            texts.append(f"{own} {passage[rng.randint(0, 20):]} {own[::-1]}")
        elif kind < 0.5:
            texts.append("a " * rng.randint(1, 80))
        else:
            texts.append(own.replace(" ", rng.choice([" ", "  ", "\n", "\t "])))
    rows = list(enumerate(texts)) + [(n, None), (n + 1, ""), (n + 2, None), (None, texts[0]), (None, passage), (3, texts[3])]
    rng.shuffle(rows)
    return rows


def by_row(rows):
    """Rows as a sorted list that copes with nulls."""
    return sorted(map(tuple, rows), key=repr)
