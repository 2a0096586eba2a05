import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import language, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_measures(spark, docs, odd):
    r = random.Random(4)
    rows = odd[:8] + odd[9:] + [(100 + i, "".join(r.choice(["a ", "b ", "a b c d e f g h ", "\n", "#", "é|", "\t", "\f", "\x0b", "\r"]) for _ in range(r.randrange(60))), "en", "a") for i in range(60)]
    got = quality.measures(docs(rows)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(slow_measures(t) for _, t, *_ in rows)


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (100, 3, 0.05), (5000, 12, 0.005), (20000, 40, 0.005), (50, 9, 0.1)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
    want = 1.0 if k >= n * p else sum(math.comb(n, i) * math.exp(i * math.log(p) + (n - i) * math.log1p(-p)) if n < 1000 else math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def test_cutoffs_hold_the_risk(spark):
    """Good documents have up to 5 symbols in 100 words; bad ones 50. A small stratum gets no cutoff."""
    r = random.Random(2)
    text = lambda n: " ".join(f"w{i}" for i in range(100)) + " " + "#" * n
    rows = [(i, text(r.randrange(6)), "en") for i in range(3000)] + [(3000 + i, text(50), "en") for i in range(50)] + [(4000 + i, text(50), "xx") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(3050)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x["kept"] for x in quality.judge(df, labels).collect()}
    assert all(out[i] for i in range(3000)) and not any(out[i] for i in range(3000, 3050)) and all(out[i] for i in range(4000, 4020))


def test_judge_odd_and_empty(spark, docs, odd):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.judge(docs(odd), labels).collect()
    assert len(got) == len(odd) and all(not (r["base_failed"] and r["kept"]) for r in got)
    assert quality.judge(docs([]), labels.limit(0)).count() == 0
    plan = quality.measures(docs(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ftrl_is_sparse_and_right():
    r = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = i % 3
        at = np.unique(np.concatenate([[y * 10 + r.integers(0, 10)], 1000 + r.integers(0, 500, 20)]))
        rows.append((at, np.full(len(at), 1 / len(at) ** 0.5), y))
    w = language.ftrl(rows, 3, l1=0.05)
    assert np.mean([(x @ w[at]).argmax() == y for at, x, y in rows]) > 0.95
    assert (w == 0).mean() > 0.95
    logits = np.stack([x @ w[at] for at, x, _ in rows]) * 10
    y = np.array([y for *_, y in rows])
    heat = language.temperature(logits, y)
    nll = lambda t: -np.mean([np.log(language._softmax(v / t)[k]) for v, k in zip(logits, y)])
    assert nll(heat) <= min(nll(0.9 * heat), nll(1.1 * heat), nll(1.0)) + 1e-9


def test_grams_count_by_characters():
    a, b, none, upper = language.grams(pa.array(["abé", "abé abé", "12 !", "ABÉ"]))
    assert a.sum() == 3 + 2 + 1 and b.sum() == 7 + 6 + 5 and none is None and (a == upper).all()


def test_languages_held_out(spark, docs, odd):
    r = random.Random(5)
    words = {"en": "the and of that with this from have which".split(), "de": "der und die das mit nicht über für schön".split(), "fr": "le les des que pour avec être où ça".split()}
    rows = [(i, " ".join(r.choices(words[x], k=r.randint(5, 60))), x, "s") for i in range(600) for x in [r.choice(sorted(words))]]
    df = docs(rows + [(1000 + (d or 0), t, None, s) for d, t, _, s in odd])
    predict = language.predictor(spark, language.learn(df))
    got = df.select("doc_id", "lang", language.held_out().alias("h"), predict("text").alias("q"), "text").collect()
    held = [g for g in got if g["h"] and g["lang"]]
    assert len(held) > 60 and np.mean([g["q"]["lang_pred"] == g["lang"] for g in held]) > 0.97
    for g in got:
        letters = any(c.isalpha() for c in g["text"] or "")
        assert (g["q"]["lang_pred"] == "und") == (not letters) and 0 <= g["q"]["score"] <= 1
    kept = language.reject_unclear(df)
    assert kept.columns == df.columns and kept.filter("lang IS NOT NULL").count() > 0.97 * 600


def test_nothing_to_learn(spark, docs):
    df = docs([(1, "some text", None, "a"), (2, None, "en", "a")])
    assert language.reject_unclear(df).count() == 0
    assert language.reject_unclear(docs([])).count() == 0


def test_every_language_is_learned(spark, docs):
    word = lambda i: "".join(chr(0x4E00 + 40 * i + j) for j in range(30))
    rows = [(10 * i + j, f"{word(i)} {word(i)[::-1]}", f"l{i:03}", "a") for i in range(300) for j in range(10)]
    for most in (50, 4000):
        model = language.learn(docs(rows), most)
        names, _ = model.predict(pa.array([word(i) for i in range(300)]))
        assert model.languages == [f"l{i:03}" for i in range(300)]
        assert np.mean([n == f"l{i:03}" for i, n in enumerate(names)]) > 0.95
