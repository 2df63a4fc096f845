"""Documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i * 7 + i * 3 + seed * 5 + i * seed) % 20] + str((i * 31 + seed) % 97) for i in range(n))


ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "no id here", "en", "b", 10),
    (3, prose(200, 1), "en", "a", 1),
    (3, prose(200, 1), "en", "a", 1),
    (4, prose(200, 1), None, "b", 1),
    (5, prose(9000, 2), "fr", None, 1),
    (6, " \t\n ", "fr", "c", 1),
    (7, "été \U0001f600 ### $$$", "fr", "c", 1),
]


def frame(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("node", "key", "kept", "size", "shard", "fp", "taken", "n_words", "component", "text2"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
