import random

import pytest

WORDS = "the of and a to in is on by be are that this with from river stone green walks under light paper house letter cold".split()
CLASHES = ["rid", "h", "sig", "n", "spans", "carry", "key", "fp", "draw", "shard", "size", "taken", "cid", "copies", "bucket", "bits", "words", "lines", "t0", "lo", "hi", "twin", "target", "kept", "score"]


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + (rng.choice("bcdfg") + rng.choice(WORDS) if rng.random() < 0.3 else "")
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, repetition, junk, empties and one long text."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    out = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    out += out[:5]
    for t in out[5:15]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 30)}\n{passage} {prose(rng, 20)}" for _ in range(8)]
    out += ["", "   \n\t", "one", "one two three", "ab " * 300, "x" * 700, "aé z ß. 12 $$$ %%% ***", prose(rng, 6000), None, None, "The THE the!", "<|endoftext|> The end <|ENDOFTEXT|>"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents as a table whose ids start at 10, with two repeated rows, two null ids, a null source and columns of clashing names."""
    langs, sources = ["en", "fr", None], ["a", "b", "c", None]
    rows = [(10 + i, t, langs[i % 3], sources[i % 7 % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += rows[:2] + [(None, texts[20], "en", "a", 1), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.selectExpr("*", *[f"'clash' AS {c}" for c in CLASHES]).persist()


@pytest.fixture(scope="session")
def labels(spark, texts):
    rows = [(10 + i, 1, i % 4 == 0 and 1 or 0) for i in range(0, 60, 2)] + [(10, 1, 1), (None, 1, 1), (99999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
