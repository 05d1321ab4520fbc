import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))

#: (doc_id, text) with NULLs, empty and long texts, repeated rows and ties.
ODD = [
    (5, "Alpha beta gamma.\nDelta epsilon zeta.\nAlpha beta gamma."), (3, "alpha  beta\tgamma."), (None, "alpha beta gamma."),
    (2, None), (2, None), (9, ""), (4, " \n\t "), (7, LONG), (6, LONG + " more"), (1, "same row"), (1, "same row"),
    (8, "Größe ÉTÉ ñandú 日本語"), (None, None), (10, "alpha beta gamma."), (11, "SAME ROW"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """ODD with columns named like those the operators add."""
    rows = [(d, t, "en" if i % 2 else None, f"k{i}", i, [i], None) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, _row long, _spans array<int>, n_chars int")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)
