"""Small document sets with the awkward cases."""

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, b int, spans string"


def random_docs(seed=3, n=60, vocabulary=40):
    """Rows (doc_id, text) of few words, with copies, shared passages, nulls,
    empty texts, repeated rows, ids that recur, and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß語") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]

    def text(k):
        return r.choice(["", " ", "\t "]) + "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\n", ". "]) for _ in range(k))

    passages = [text(r.randint(8, 30)) for _ in range(5)]
    out = []
    for i in range(n):
        t = text(r.randint(0, 60))
        if r.random() < 0.5:
            t = t + r.choice(passages) + text(r.randint(0, 9))
        if r.random() < 0.25 and out:
            t = out[r.randrange(len(out))][1]
            if t and r.random() < 0.5:
                t = t.replace(" ", " x ", 1)
        out.append((i * 3 % 101, t))
    out += [(900, None), (901, ""), (902, " \n\t "), (None, passages[0] * 2), (None, None), (903, "A" * 500), (904, "A" * 490),
            (905, text(4000)), (906, "Ünïcode ﷺ 😀 " * 30), (907, "Ünïcode ﷺ 😀 " * 29)]
    return out + [out[5], out[5], (out[6][0], out[7][1])]


def frame(spark, rows):
    """With the columns of documents and some whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "en", None, None if t is None else len(t), 0.5, "k", 1, "s") for d, t in rows], EXTRA)
