"""The pipeline's stages, each held against its operator by plain Python on its own input; and the registration."""

import re
from collections import Counter

import numpy as np
import pytest

cp = pytest.importorskip("corpus_pipeline")

from tallyport.llm import word_bpe  # noqa: E402
from tallyport.llm.kneser_ney import quality_classifier  # noqa: E402
from tallyport.llm.mixing import mixing_plan  # noqa: E402
from tallyport.llm.shared import Workspace, table  # noqa: E402
from tallyport.llm.simhash_golay import simhash_groups  # noqa: E402

from .test_operators import plain_spans  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    ws, docs = Workspace(spark), table(spark, sf_dir, "documents")
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5

    out = ws.save(cp.STAGES[0][1](spark, docs, sf_dir), "a")
    kept = {r.doc_id for r in quality_classifier(docs, table(spark, sf_dir, "labels")).where("kept").collect()}
    assert out.columns == docs.columns and set(by_id(out)) == kept and 0 < len(kept) < docs.count()

    docs, out = out, ws.save(cp.STAGES[1][1](spark, out, sf_dir), "b")
    groups = simhash_groups(docs).collect()
    assert set(by_id(out)) == {r.component_id for r in groups} and out.count() < docs.count()

    docs, out = out, ws.save(cp.STAGES[2][1](spark, out, sf_dir), "c")
    before, after = by_id(docs), by_id(out)
    ids = sorted(before)
    raw = [before[i].text.encode() for i in ids]
    for i, b, gone in zip(ids, raw, plain_spans(raw, 200), strict=True):
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if WORD.search(rest):
            assert after[i].text == rest and after[i].n_chars == len(rest) and after[i].source == before[i].source
        else:
            assert i not in after

    docs, out = out, ws.save(cp.STAGES[3][1](spark, out, sf_dir), "d")
    plan = {r.doc_id: r.taken for r in mixing_plan(docs).collect() if r.taken}
    assert {i: len(WORD.findall(r.text)) for i, r in by_id(out).items()} == plan

    docs, out = out, cp.STAGES[4][1](spark, out, sf_dir)
    lengths = Counter()
    for r in out.collect():
        lengths[r.doc_id] += r.length
    library = word_bpe.word_ids(word_bpe.default_path()).library
    assert lengths == {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in by_id(docs).items()}


def test_registered(spark):
    import __spark_entry__ as entry

    found = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in [*(root / "tallyport").rglob("*.py")]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_stages_on_edge_rows(spark, sf_dir, docs):
    """Nulls in every column, empty texts, repeated rows and ids, ids of unlike texts, further columns with clashing names; then an empty table."""
    more = spark.createDataFrame([(12, "another text under the id of twelve, with words of its own", "en", "a", 1), (None, "a text without an id � of its own", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.unionByName(more, allowMissingColumns=True)
    ws, columns = Workspace(spark), list(cp.COLUMNS)
    key = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())

    found = quality_classifier(rows, table(spark, sf_dir, "labels"), carry=cp.COLUMNS).where("kept")
    out = ws.save(cp.STAGES[0][1](spark, rows, sf_dir), "a")
    assert out.columns == columns and key(out) == key(found.select("carry.*")) and key(out)

    rows = rows.select(*columns)
    groups = simhash_groups(rows, carry=("text",)).collect()
    out = ws.save(cp.STAGES[1][1](spark, rows, sf_dir), "b")
    kept = key(out)
    assert out.columns == columns and max(kept.values()) == 1 and sum(kept.values()) == len({r.root for r in groups})
    roots = {(r.doc_id, r.carry.text): r.root for r in groups}
    assert {roots[k[:2]] for k in kept} == {r.root for r in groups}
    for k in kept:  # the smallest id of its group, null last
        assert k[0] == min((r.doc_id for r in groups if r.root == roots[k[:2]] and r.doc_id is not None), default=None)

    out = ws.save(cp.STAGES[2][1](spark, out, sf_dir), "c")
    assert out.columns == columns and all(WORD.search(r.text) and r.n_chars == len(r.text) for r in out.collect())
    assert any("�" in r.text for r in out.collect())
    for name in ("d", "e"):
        stage = cp.STAGES["abcde".index(name)][1]
        out = ws.save(stage(spark, out, sf_dir), name)
        assert out.count()
        if name == "d":
            assert out.columns == columns

    nothing = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0
