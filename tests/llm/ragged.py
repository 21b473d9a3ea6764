import pytest

#: Extra columns whose names the operators use themselves.
EXTRA = "id long, row string, slot long, words string, pos int, hits string, score string, node string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with null and clashing extra columns."""
    def make(pairs):
        rows = [(i, t, None, "x", 7, None, 1, "h", None, "n", None) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA).repartition(3)

    return make


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def ragged_pairs():
    """Null and empty texts, null ids, white space only, one very long text, repeated rows and ids."""
    line = "a line that several documents have in common, long enough to count"
    return [
        (1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, LONG), (5, LONG), (6, LONG + " end"),
        (None, "alpha beta gamma delta"), (None, None), (7, f"{line}\nsecond\n"), (8, f"  {line.upper()}  \n\n{line}"), (9, line), (10, f"x\n{line}"), (11, f"{line}\r\nlast"),
        (None, line), (12, "é Ünïcode ßtraße　word \x1c sep\x85arated"), (-3, "Alpha BETA gamma delta"), (13, "one"), (13, "two words"),
    ]
