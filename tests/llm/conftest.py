import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A shared folder for written tables, and few partitions."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(shared, folder):
    return shared.read.parquet(f"{folder}/documents.parquet")


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(shared):
    """Nulls, empty and very long texts, ties and repeated rows, other white space, and a column with a clashing name."""
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [
        None, "", " \n\t ", "one", "One  two\u00a0three\u2003four", LONG, LONG, f"a b {passage} c", f"d {passage} e f", passage, passage.upper(), "x " * 60,
        "a\x1cb \u3000 c <|endoftext|> d<|endoftext|>", "don't stop  it's\n\n fine , really... \u65e5\u672c \u8a9e",
    ]
    rows = [(i * 3, t, f"s{i}", "k") for i, t in enumerate(texts)]
    return shared.createDataFrame(rows, "doc_id long, text string, chunk string, key string").repartition(3)
