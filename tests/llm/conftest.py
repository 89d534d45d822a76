import hashlib

import pytest

BENCH = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    """A documents table of given texts; ids from 0, sources and languages in turn."""

    def build(texts, **more):
        rows = [(i, t, ("en", "de", None)[i % 3], (None, "src0", "src1")[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return build


@pytest.fixture(scope="session")
def prose():
    """Texts of words drawn by a hash, the same on every run."""

    def build(n, words=60, seed=0):
        out = []
        for i in range(n):
            digest = [hashlib.md5(f"{seed}-{i}-{j}".encode()).hexdigest() for j in range(words)]
            out.append(" ".join("".join(chr(97 + int(c, 16)) for c in d[: 3 + int(d[0], 16) % 5]) for d in digest))
        return out

    return build
