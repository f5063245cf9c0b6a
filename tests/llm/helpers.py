"""Documents with every awkward case: nulls in any column, empty, blank, wordless, tied, repeated and very long texts, and extra columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, hits0 string, component_id string, fp string"

ENGLISH = "the quick brown fox jumps over the lazy dog while seven wise old owls look on from the tall oak near the river"
FRENCH = "le renard brun saute par dessus le chien paresseux pendant que sept vieux hiboux regardent depuis le grand chêne"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(120_000))


def rows():
    r = [
        (1, ENGLISH, "en", "a"),
        (2, ENGLISH, "en", "b"),
        (3, ENGLISH.upper(), "en", None),
        (4, FRENCH, "fr", "a"),
        (5, "", "en", "b"),
        (6, None, None, None),
        (7, " \n\t ", "fr", "c"),
        (8, "123 ... !!!", "en", "a"),
        (9, LONG, "en", "a"),
        (10, "two words", None, "b"),
        (None, ENGLISH, "en", "a"),
        (None, None, None, None),
        (11, "é", "fr", "\U0001f600"),
        (12, "tie tie tie", "en", "c"),
        (13, "a\n\nb\nb\nb", "en", "a"),
        (1, ENGLISH, "en", "a"),  # a repeated row
        (14, "Licence text: \x00 control and <|endoftext|> special </s>", "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 0.5, 7, "x", "y", "z") for i, t, lang, s in r]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
