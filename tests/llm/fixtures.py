"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __w string, kept int, score string, th string, fingerprint int"
WORDS = "the of and to in river stone light window garden morning letter village teacher winter bridge market silver paper music".split()


def prose(rnd, n):
    out = []
    while len(out) < n:
        k = rnd.randrange(6, 14)
        s = [rnd.choice(WORDS) + rnd.choice(["", "", "", "s", "ed", "ing"]) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def documents(n=160, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(prose(rnd, rnd.randrange(20, 60)) for _ in range(rnd.randrange(1, 5)))
        rows.append([i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", None])])
    rows[5][1] = rows[4][1]
    rows[6][1] = rows[4][1].replace("river", "rivers", 1)
    rows[7][1] = None
    rows[8][1] = ""
    rows[9][1] = " \n\t "
    rows[10][1] = "word"
    rows[11][1] = " ".join(f"{w}###$$$" for w in prose(rnd, 200).split())
    rows[12][1] = "same words again " * 200
    rows[13][1] = prose(rnd, 30000)
    rows[14][1] = rows[13][1] + "\n" + rows[4][1]
    rows.append(list(rows[20]))
    rows.append([None, rows[21][1], "en", "a"])
    rows.append([None, prose(rnd, 80), "en", "a"])
    return [(*r, None if r[1] is None else len(r[1]), "x", 7, "s", None, i) for i, r in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
