"""Small tables with the cases that every operator must stand."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns.
CLASH = "key string, name string, size long, n long, score double, spans string, hits_ string, label string, score_ double"


def rows(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = [a + b for a in ("ba", "ko", "mi", "tu", "re", "so") for b in ("lan", "der", "no", "vi", "ster", "qu")]
    said = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    out = []
    for i in range(n):
        text = "\n".join(said(r.randint(3, 30)).capitalize() + "." for _ in range(r.randint(1, 6)))
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(text)))
    long = said(9000)
    out += [
        (100, None, None, None, None), (101, "", "en", "a", 0), (102, "   \n\t", "en", "b", 5), (103, "one", "en", "a", 3), (104, long, "en", "a", len(long)), (105, long, "de", "b", len(long)),
        (106, "x" * 60_000, "en", "a", 60_000), (107, "é€ 漢字   😀 tail", None, "z", 12), out[0], out[0], (None, out[1][1], "en", "a", 1), (None, None, None, None, None),
    ]
    return out


def docs(spark, data=None, extra=False):
    data = rows() if data is None else data
    if not extra:
        return spark.createDataFrame(data, DOC)
    return spark.createDataFrame([(*d, "k", "n", 1, 1, 0.5, "s", "h", "l", 1.0) for d in data], f"{DOC}, {CLASH}")


def benchmark(spark, data=((1, "ba lan"), (2, None), (3, ""), (None, "zz yy xx ww vv uu tt ss rr qq pp oo"))):
    return spark.createDataFrame(list(data), "item_id long, text string")


def labels(spark, data=None):
    data = [(i, 1 if i % 4 else 0, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 1)] if data is None else data
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
