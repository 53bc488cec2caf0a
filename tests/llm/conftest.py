import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, shard string, slot string, base string, added string, score string, root string, row string"


def odd_rows():
    r = random.Random(3)
    words = ["the", "of", "Anea", "thing", "über", "ñandú", "42", "re-do", "x@y.org", "😀", "end."]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, text(r.randint(3, 60)), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for k in range(60)]
    rows += [(100, rows[0][1], "en", "a"), (101, rows[0][1], None, "b"), (102, rows[1][1] + " end", "en", "a")]
    rows += [(200, None, "en", "a"), (201, "", "en", None), (202, " \n\t ", None, "a"), (203, "one", "de", "a"), (204, "one two", "de", "a")]
    rows += [(None, "no id here at all, but words", "en", "a"), (None, None, None, None), (None, rows[2][1], "en", "a")]
    rows += [(300, text(20_000), "en", "a"), (301, "a" * 30_000, "en", "a"), (302, "1 " * 5_000, "en", "a"), (303, "line\n" * 400, "en", "a")]
    rows += [(5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a"), (6, "same id, other text", "en", "b")]
    return [(i, t, lang, source, None if t is None else len(t), *["clash"] * 9) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('odd')}/documents.parquet"
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")
