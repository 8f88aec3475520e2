import pytest
from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("ta", "so", "ve", "li", "ro", "da", "fu")]


def prose(n, seed):
    """n words that look random; equal seeds give equal texts."""
    x, out = seed * 2654435761 + 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 7))
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, ties, NULLs in every column, empty and long texts, repeated rows, a hot source."""
    base = [prose(60 + 7 * i, i) for i in range(12)]
    rows = [(i, t, "en", "s1" if i % 2 else "s0", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "hot", 5) for i in range(20)]  # exact copies
    for i in range(25):  # near copies: one word changed, each elsewhere
        words = base[3].split()
        words[(i * 3) % len(words)] = f"other{i % 9}"
        rows.append((200 + i, " ".join(words), "en", "hot", 5))
    passage = prose(40, 77)
    rows += [(300 + i, f"{prose(30, 400 + i)} {passage}\n{prose(25, 500 + i)}", "fr", "hot", 5) for i in range(6)]
    rows += [
        (400, None, None, None, None), (401, "", "en", None, 0), (402, " \t\n ", "de", "s1", 4), (403, "one", None, "s1", 3),
        (404, "One\ttwo", "en", "s1", 7), (405, "one two", "en", "s1", 7), (None, base[5], "en", "s1", 5), (None, None, None, None, None),
        (406, " ".join(["again"] * 300), "en", "s2", 5), (407, prose(9000, 9), "en", "s2", 5), (1, base[1], "en", "s1", len(base[1])),
        (408, "Ünïcödé wörds — “quoted” 漢字 und so weiter " * 8, "de", "s2", 5),
    ]
    return [Row(doc_id=a, text=b, lang=c, source=d, n_chars=e) for a, b, c, d, e in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from kinweave.plans.lineage import cut

    return cut(spark.createDataFrame(corpus, DOCS))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wide(docs):
    """The documents with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "tie", "link", "words", "n", "a", "b", "n_words", "kept", "tail", "target", "copies", "shard", "slot", "items", "cover", "key", "owner"]
    return docs.withColumns({name: F.lit(f"x{i}") for i, name in enumerate(names)})
