import pytest

#: Cases that every operator meets: null and empty texts, copies, repeated rows, odd characters, a long text.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))


@pytest.fixture(scope="session")
def tricky():
    near = [f"word{i}" for i in range(60)]
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "Hello World"), (5, "hello world"), (6, "HELLO  world"), (7, " ".join(near)), (8, " ".join(near[:-1] + ["other"])), (8, " ".join(near[:-1] + ["other"])),
        (9, "ÀÉÎ çñ ß 漢字 İ ſ   x y"), (10, LONG), (11, LONG), (12, "a " * 300), (None, "no identifier here"), (13, "x" * 5000), (14, "mail a@b.co or +1 (555) 123-4567, 4111 1111 1111 1111 at 10.0.0.1")]


@pytest.fixture(scope="session")
def docs(spark, tricky):
    """The cases with a clashing name or two beside them."""
    rows = [(i, t, "en" if i else None, "s1" if i and i % 2 else None, len(t or ""), "clash", 1) for i, t in tricky]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, id int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
