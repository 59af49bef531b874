"""Rows that every operator must take: nulls, empties, repeats, a long text, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, n int, w int, p int, r int, hash string, length int, bucket int, `key` string, `a.b` int"
LONG = "".join(f"word{i} of a long text goes on " + ("\n" if i % 9 == 0 else "") for i in range(9000))


def rows():
    texts = [
        (0, "the cat sat on the mat and saw the dog run"),
        (1, None),
        (2, ""),
        (3, " \n\t \n"),
        (4, "the cat sat on the mat and saw the dog run"),
        (4, "the cat sat on the mat and saw the dog run"),
        (5, "one"),
        (6, "ONE"),
        (7, "Ünïcödé 字 words — and\x00 control\x1cs\n\nblank line above"),
        (8, LONG),
        (9, LONG + " tail"),
        (None, "a text without an id that is long enough to be seen twice"),
        (None, "a text without an id that is long enough to be seen twice"),
        (None, None),
        (10, "12345 !!! ???"),
        (-5, "a negative id is an id as well, of course it is"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None, "x", "y", 1, 2, 3, 4, "h", 5, 6, "k", 7) for k, (i, t) in enumerate(texts)]


def frame(spark, which=None):
    return spark.createDataFrame(rows() if which is None else which, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
