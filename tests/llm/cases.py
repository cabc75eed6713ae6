"""Small tables with awkward rows: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, bucket long, g string, node long, label string, n string, y string, key string, __key string, lost string, first string, wanted string, line_no string"
NAMES = [c.split()[0] for c in DOC_SCHEMA.split(", ")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def awkward_texts(seed=0):
    rng = random.Random(seed)
    base = sentence(rng, 80)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(5, 60, 6)]
    return [
        None, "", " ", "\n", "one", "one two", "ONE two", base, base, base.upper(), *near, sentence(rng, 300),
        "Ünïcödé ßtraße 株式会社 の テスト 😀 ▁mark  double  blanks\ttab\r\nline", "x" * 30_000, "word " * 20_000,
        "a b c d e", "a b c d e f", "<|endoftext|> and </s> and <s>", "\x00\x1c\x85", *(sentence(rng, rng.randint(1, 40)) for _ in range(30)),
    ]


def documents(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), "s", 1, "g", 2, "l", "n", "y", "k", "kk", "a", "b", "c", "d") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def awkward(spark, seed=0):
    """Documents with repeated rows and a missing id at the end."""
    texts = awkward_texts(seed)
    return documents(spark, [*texts, texts[7], texts[7], sentence(random.Random(9), 30)], [*range(len(texts)), 7, 7, None])


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
