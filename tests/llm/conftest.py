import pytest

CLASHES = {"_text": "a", "score": 1.0, "drop": "d", "going": 1, "row": 2, "gone": True, "node": 5, "digest": "x", "copies": 9, "block": 7, "id": 3, "n": 1, "keep": 4, "y": 0, "label": 1, "held_out": True, "_h": 1, "p": 0.5, "tokens": 2}


@pytest.fixture(scope="session")
def table(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, source), with columns whose names could clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) + tuple(CLASHES.values()) for r in rows]
        kinds = {str: "string", float: "double", int: "bigint", bool: "boolean"}
        extra = ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in CLASHES.items())
        return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")

    return make
