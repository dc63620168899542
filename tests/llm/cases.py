"""A small table with everything that may be wrong with a table of documents."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators may use for themselves.
CLASHES = "rid run sha size bin bucket chunk range node fp slot a b u k rank copies target part place bag rejected toxic kept keep_id mix_source mix_times mix_one dropped_id mixed_id mixed_sha label_id piece start length offset sequence_id TEXT_SHA256 first_id root".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = [prose(rng, 80) for _ in range(6)]
    passage = prose(rng, 60)
    near = base[0].split(" ")
    near[40] = "changed"
    long_text = prose(rng, 9000)
    rows = [
        (1, base[0], "en", "s1"),
        (2, base[0].replace(" ", " \n\t"), "en", "s1"),
        (3, " ".join(near), "en", None),
        (4, base[1] + "\n" + passage, "en", "s2"),
        (5, passage + "\n" + base[2], None, "s2"),
        (6, None, "en", "s2"),
        (7, "", None, None),
        (8, " \t ", "en", "s3"),
        (9, long_text, "en", "s1"),
        (10, long_text, "en", "s1"),
        (11, base[3], "en", "s1"),
        (11, base[3], "en", "s1"),
        (12, base[4], "en", "s1"),
        (12, base[5], "en", "s2"),
        (None, base[1], "en", "s1"),
        (None, base[5], None, "s3"),
        (13, "one", "en", "s3"),
        (14, "Two Words", "en", "s3"),
        (15, "it's  Ünïé 12a3 <|endoftext|> 日本　x y\x1c", "de", "\U0001f600"),
        (-3, base[2].upper(), "en", "￿"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, clashes=False, rows=None):
    df = spark.createDataFrame(documents() if rows is None else rows, COLUMNS)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHES)])
    return df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
