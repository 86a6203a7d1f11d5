import uuid

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(tmp_path_factory):
    """The tests' own shared folder, since their session has no checkpoint folder."""
    from cohortgrid.llm import common

    base, before = tmp_path_factory.mktemp("shared"), common.scratch
    common.scratch = lambda spark, purpose: f"file://{base}/{purpose}-{uuid.uuid4().hex}"
    yield base
    common.scratch = before


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows like ``documents`` from ``(doc_id, text)`` or ``(doc_id, text, source)``."""
    from cohortgrid.llm.common import tuned

    tuned(spark)

    def build(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


def sentence(seed: int, n: int) -> str:
    """n words that depend on the seed."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 100_003}" for i in range(n))


@pytest.fixture(scope="session")
def say():
    return sentence
