import pytest

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b "),
    (6, "one"),
    (7, "one two"),
    (7, "one two"),
    (None, "one two"),
    (8, "a  b\tc\nd 'quoted' émigré 日本語 " * 400),
    (9, "x " * 30000),
]


# Names of operators' outputs and of columns that they use on the way, with values of other types.
CLASH = {c: "x" for c in ("component_id", "root", "lang_pred", "ids", "round_trip", "parity", "row_number", "kept")} | {c: 0.5 for c in ("predicted", "n_tokens", "sequence_id", "offset", "shard", "slot", "length", "rid", "grp")}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows, a null id and columns that clash with outputs."""
    rows = [(i, t, "en", "s", 0, "kept", -1.0, 3, *CLASH.values()) for i, t in ROWS]
    clash = "".join(f", {c} {'string' if isinstance(v, str) else 'double'}" for c, v in CLASH.items())
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, fp string, score double, start int{clash}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
