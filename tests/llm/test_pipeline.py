"""The pipeline's stages, each on what the one before it kept, against their brute-force versions."""

import hashlib

import corpus_pipeline as cp
import public_tokenizers as P

from metaloom.llm import decontamination, pii, toxicity
from metaloom.llm.common import table
from tests.llm.test_byte_bpe import encoding
from tests.llm.test_decontamination import brute as brute_overlaps
from tests.llm.test_near_dedup import brute_classes


def test_stages_and_run(spark, small):
    docs = table(spark, small, "documents")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, small)
        path = cp.keep(out, name)
        seen[name] = {r.doc_id: r for r in path.collect()}
        if name != "byte_bpe":
            assert out.columns == columns, name
        docs = path
    before = {r.doc_id: r for r in table(spark, small, "documents").collect()}

    scores = toxicity.score(table(spark, small, "documents"), table(spark, small, "labels"))
    assert set(seen["toxicity"]) == {r.doc_id for r in scores.where("predicted = 0").collect()}

    left = sorted(seen["toxicity"])
    roots = brute_classes([before[i].text for i in left])
    first = {}
    for k, root in roots.items():
        first[root] = min(first.get(root, left[k]), left[k])
    assert set(seen["near_dedup"]) == set(first.values())

    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    dirty = {d for d, _ in brute_overlaps([(i, before[i].text) for i in seen["near_dedup"]], items)} if len(seen["near_dedup"]) < 40 else {r.doc_id for r in decontamination.overlaps(spark.createDataFrame([(i, before[i].text) for i in seen["near_dedup"]], "doc_id long, text string"), table(spark, small, "benchmark")).collect()}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - dirty

    assert set(seen["pii"]) == set(seen["decontamination"])
    for r in seen["pii"].values():
        assert not pii.found_in(r.text)[0], r.doc_id
        assert r.n_chars == len(r.text)

    want = encoding()
    for i, r in seen["byte_bpe"].items():
        own = want.encode_ordinary(seen["pii"][i].text)
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    assert {tuple(r) for r in cp.run(spark, small).collect()} == {tuple(r) for r in seen["byte_bpe"].values()}
    assert P.PATTERN


def test_stages_take_odd_rows(spark, small):
    """Nulls, repeated rows and extra columns pass all stages; so does an empty table."""
    rows = [(1, None, None, None, None, "x"), (None, "some text", "en", "s", 9, "x"), (2, "", "en", "s", 0, "x"), (3, "same words stand here twice", "en", "s", 9, "x"), (3, "same words stand here twice", "en", "s", 9, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    for docs in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            docs = cp.keep(stage(spark, docs, small), name)
        assert docs.count() in (0, 3)
