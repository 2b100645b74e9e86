import hashlib
import random

import numpy as np
import public_tokenizers as P

from metaloom.llm import packing
from metaloom.llm.common import new_dir
from metaloom.llm.warc import filesystem

PATH = P.path("byte_bpe_50k.tiktoken")


def plain_best_fit(lengths, row):
    room, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(r, at) for at, r in enumerate(room) if r >= lengths[i]]
        if fits:
            at = min(fits)[1]
        else:
            at = len(rows)
            rows.append([])
            room.append(row)
        rows[at].append(i)
        room[at] -= lengths[i]
    return rows


def test_tree_finds_the_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        row = rng.choice([1, 7, 64, 100])
        lengths = [rng.randint(1, row) for _ in range(rng.randint(0, 80))]
        got, want = packing.best_fit(lengths, row), plain_best_fit(lengths, row)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        fill = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)
        assert fill(got) == fill(want)


def test_round_trip(spark):
    texts = ["", None, "word " * 5000, "a b c", "a b c"] + [f"text {i} " * (i % 40) for i in range(100)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "a b c", "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, file string")
    coder = packing.encoding(PATH, P.PATTERN)
    s = packing.Settings(row=64, buffer_tokens=3000)
    folder = new_dir(spark, "packed")
    manifest = packing.write(documents.repartition(3), folder, PATH, P.PATTERN, s)
    got = sorted([(r.doc_id, r.n_tokens, r.n_pieces, r.ids_sha256) for r in packing.read(manifest, folder, s).collect()], key=str)
    want = []
    for i, t, _ in rows:
        ids = coder.encode_ordinary(t or "")
        want.append((i, len(ids) + 1, -(-(len(ids) + 1) // 64), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    fs, path = filesystem(folder)
    for f in manifest.collect():
        ids, lengths, positions = packing.load(fs, path, f.file, f.sha1, s)
        assert ids.shape == positions.shape and len(lengths) == len(ids) == f.rows
        assert all(x[0] == 0 and (np.diff(x) > 0).all() and x[-1] <= s.row for x in lengths)
        used = sum(int(x[-1]) for x in lengths)
        assert used > 0.8 * ids.size or len(ids) < 3
    assert packing.round_trip(spark, documents.limit(0), PATH, P.PATTERN).count() == 0
