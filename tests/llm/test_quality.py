"""Quality rules: traits against plain Python, the estimation against what made the votes."""

import random
import re

from metaloom.llm import quality

SCHEMA = "doc_id long, text string, n_words int, vote_length string"
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(i, text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    covered = {p + o for p, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def texts():
    rng = random.Random(3)
    words = "a b c the of # $5 x|y <br> \U0001d538 é 日本 .".split()
    blanks = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x85", "\xa0"]
    some = ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 150))) for _ in range(80)]
    return [*some, "", None, " \n \n", "a", "a a", "a a a", "a a a a", "same line\nsame line\n same line\n\n\n", "x" * 5000, "w " * 4000, "\r\n".join(["one two three"] * 30), "# " * 60]


def test_traits(spark):
    rows = [(n, t, 0, "clash") for n, t in enumerate(texts())]
    rows += [rows[2], rows[2], (None, "null id", 0, ""), (None, None, 0, "")]
    got = quality.quality(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.select(*BASE).collect()), key=repr) == sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert not [r for r in got.collect() if r["kept"] and r["base_failed"]]
    assert quality.quality(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimation_finds_accurate_rules():
    """Votes drawn from known chances: the posterior finds the class far better than the best single rule."""
    rng = random.Random(11)
    on_good, on_bad = (0.05, 0.15, 0.8), (0.6, 0.2, 0.2)
    counts, truth = {}, []
    for _ in range(6000):
        good = rng.random() < 0.75
        v = tuple(rng.choices((-1, 0, 1), (on_good if good else on_bad) if j < 5 else (0.2, 0.6, 0.2))[0] for j in range(7))
        counts[v] = counts.get(v, 0) + 1
        truth.append((v, good))
    model = quality.fit(list(counts.items()), rules=7)
    assert abs(model.good - 0.75) < 0.03
    for j in range(5):
        assert abs(model.on_good[j][2] - 0.8) < 0.05 and abs(model.on_bad[j][0] - 0.6) < 0.08
    assert all(abs(w) < 0.4 for j in (5, 6) for w in model.weights()[j])  # rules that know nothing weigh nothing
    right = sum((quality._posterior(v, model.good, model.weights()) >= 0.5) == good for v, good in truth) / len(truth)
    assert right > 0.95
    assert quality.fit(list(reversed(list(counts.items()))), rules=7) == model
    assert quality.fit([], rules=3).good == quality.Settings().start_good


def test_expression_is_the_posterior(spark):
    names = [r.name for r in quality.RULES]
    model = quality.Model(0.6, tuple((0.1 + j / 100, 0.2, 0.7 - j / 100) for j in range(len(names))), tuple((0.5, 0.3, 0.2) for _ in names))
    rng = random.Random(2)
    rows = [tuple(rng.choice((-1, 0, 1)) for _ in names) for _ in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"vote_{n} int" for n in names))
    for r in df.withColumn("p", quality.probability(model)).collect():
        assert abs(r["p"] - quality._posterior(tuple(r)[:-1], model.good, model.weights())) < 1e-12


def test_clean_texts_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rated = quality.quality(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = [[r["kept"] for r in rated if r["quality"] == q] for q in (1, 0)]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_plan_has_no_python(spark, small):
    found = quality.traits(spark.read.parquet(f"{small}/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
