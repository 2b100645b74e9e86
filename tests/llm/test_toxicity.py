import random
import zlib

import numpy as np

from metaloom.llm import toxicity as tx

SMALL = tx.Settings(buckets=1 << 12, epochs=2, filters=4, window=50)


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        vocabulary = [f"{lang}{k}" for k in range(200)]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"] if lang == "en" else ["trottel", "lump"]) + rng.choice(["", ".", ","]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def tables(spark, rows, extra=()):
    documents = spark.createDataFrame([(i, t, lang, "s", 5) for i, t, lang, _ in rows] + list(extra), "doc_id long, text string, lang string, source string, score int")
    return documents, spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = made(900, 1)
    documents, labels = tables(spark, rows, [(None, None, None, None, 1), (5000, "", "en", "s", 1), (5000, "", "en", "s", 1), (5001, "word " * 30000 + "idiot", "en", "s", 1)])
    got = tx.score(documents, labels, SMALL).collect()
    assert len(got) == 904
    by = {r.doc_id: r for r in got}
    for i, _, _, _ in rows:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(by[i].predicted, y) for i, _, _, y in rows if by[i].held_out]
    right = np.mean([p == y for p, y in held])
    assert right > 0.95, right
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert by[5000].predicted == 0 and by[None].predicted == 0 and by[5001].predicted == 1
    clean = tx.keep_clean(documents, labels, SMALL)
    assert clean.columns == documents.columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_labels_are_no_inputs(spark):
    """Other languages, sources and held-out labels change no score."""
    rows = made(300, 2)
    documents, labels = tables(spark, rows)
    first = {r.doc_id: r.score for r in tx.score(documents, labels, SMALL).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    other, turned = tables(spark, [(i, t, "xx" if held(i) else lang, 1 - y if held(i) else y) for i, t, lang, y in rows])
    assert first == {r.doc_id: r.score for r in tx.score(other, turned, SMALL).collect()}


def test_no_labels_and_no_rows(spark):
    documents, labels = tables(spark, made(5, 3))
    assert {r.score for r in tx.score(documents, labels.limit(0), SMALL).collect()} == {0.5}
    assert tx.score(documents.limit(0), labels, SMALL).count() == 0


def test_windows_change_nothing():
    rows = made(60, 4)
    model = tx.train([(t, lang, y) for _, t, lang, y in rows], SMALL)
    texts = [t for _, t, _, _ in rows]
    whole = model.scores(texts, tx.Known(model))
    model.settings = tx.Settings(buckets=1 << 12, epochs=2, filters=4, window=7, cache=50)
    assert np.allclose(whole, model.scores(texts, tx.Known(model)))


def loss(model, ids, buckets, label):
    pooled, _ = model.read(ids, model.matrix(buckets))
    z = np.maximum(pooled, 0) @ model.head + model.offset
    return float(np.log1p(np.exp(-z if label else z)))


def test_gradients_against_differences():
    s = tx.Settings(buckets=64, size=4, filters=3, prefixes=(3,))
    rows = [(t, lang, y) for _, t, lang, y in made(80, 5)]
    model = tx.train(rows, tx.Settings(buckets=64, size=4, filters=3, prefixes=(3,), epochs=1))
    vocabulary = tx.Vocabulary(s)
    ids = vocabulary.encode(rows[0][0])
    buckets = np.asarray(vocabulary.rows)
    for name in ("table", "head"):
        setattr(model, name, getattr(model, name).astype(float))
    model.kernels, model.biases = [k.astype(float) for k in model.kernels], [b.astype(float) for b in model.biases]
    for label in (0, 1):
        found = tx.gradients(model, ids, buckets, label)
        table = np.zeros_like(model.table)
        for at, change in found["table"]:
            for b in at:
                table[b] += change
        pairs = [(model.head, found["head"]), (model.table, table), *zip(model.kernels, found["kernels"], strict=True), *zip(model.biases, found["biases"], strict=True)]
        for values, grads in pairs:
            for spot in np.ndindex(*values.shape) if values.size < 60 else [np.unravel_index(i, values.shape) for i in np.flatnonzero(grads)[:20]]:
                kept = values[spot]
                values[spot] = kept + 1e-5
                up = loss(model, ids, buckets, label)
                values[spot] = kept - 1e-5
                down = loss(model, ids, buckets, label)
                values[spot] = kept
                assert abs((up - down) / 2e-5 - grads[spot]) < 1e-4


def test_training_beats_the_start(spark):
    """Held-out log loss on the given tables: the trained network's is below that of the embeddings it starts from."""
    where = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}

    def held_out(s):
        rows = [(r.score, truth[r.doc_id]) for r in tx.score(documents, labels, s).collect() if r.held_out and r.doc_id in truth]
        p, y = np.clip(np.array([r[0] for r in rows]), 1e-3, 1 - 1e-3), np.array([r[1] for r in rows])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    assert held_out(tx.Settings()) < held_out(tx.Settings(epochs=0))


def test_a_text_over_the_bound_is_passed_over(spark):
    """One long text that sorts first doesn't empty the sample."""
    docs = spark.createDataFrame([(i, "long " * 300 if i % 4 == 0 else f"text {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    found = tx.sample(docs, labels, tx.Settings(sample_chars=1000))
    assert len(found) > 10 and all(len(text) < 20 for text, _, _ in found)
