import pytest

WORDS = "amber brook cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north oasis plain quarry ridge shore tarn upland valley weir yarrow zenith".split()


def prose(n: int, seed: int = 0) -> str:
    """n words without repeats of short windows, alike for the same seed."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(state >> 33) % len(WORDS)] + str((state >> 40) % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, a very long one, repeated rows, and columns with clashing names."""
    rows = [
        (None, None), (None, prose(60, 1)), (1, ""), (2, " \n\t "), (3, prose(80, 3)), (3, prose(80, 3)), (3, prose(80, 4)), (4, None),
        (5, "one two"), (6, prose(60_000, 6)), (7, prose(80, 3)), (8, "é" * 70 + " ünï " + prose(55, 8)), (9, "x" * 300_000),
    ]
    clash = "doc_id long, text string, n long, node long, key long, rows long, part int, word string, item long, kept boolean, component string, text_hash string, toxic int, quality string"
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "w", 6, True, "c", "h", 1, "q") for i, t in rows], clash)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
