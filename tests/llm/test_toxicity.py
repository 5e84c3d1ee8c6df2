import os
import re
import time
import zlib

import numpy as np
import pytest
from aerolytics.llm import registry, toxicity
from aerolytics.llm.toxicity import INSULTS, NAMES, SECOND, Isotonic, Lexicon, Trees, features, fit, scored, train, without_toxic
from pyspark.sql import functions as F

import fixtures as fx

SF = "/root/testdata/sf0.1"


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b[None]).mean() + (a[:, None] == b[None]).mean() / 2).item()


def test_held_out_accuracy(spark):
    rows = registry.op3_toxicity(spark, SF)
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = rows.toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out, strict=True))
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    y, s = held.toxic.to_numpy(), held.score.to_numpy()
    assert auc(s, y) > 0.97
    assert ((s >= 0.5) & (y == 1)).sum() >= 0.85 * y.sum() and ((s >= 0.5) & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def test_features():
    x = dict(zip(NAMES, features(["You are an IDIOT!!! you st00pid 1d1ot, s t u p i d loooser"], Lexicon())[0], strict=True))
    assert x["insults"] == 1 and x["near_second"] == 1 and x["leet"] >= 1 and x["spaced"] == 1 and x["exclaim"] > 0 and x["shouted"] > 0 and x["drawn"] > 0
    assert not features(["", None], Lexicon()).any()


def test_trees_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    raw = Trees().fit(x[:2000], y[:2000].astype(float)).raw(x[2000:])
    assert auc(raw, y[2000:]) > 0.97
    s = r.normal(size=4000)
    p = 1 / (1 + np.exp(-2 * s))
    iso = Isotonic().fit(s, (r.random(4000) < p).astype(int))
    grid = np.linspace(-2, 2, 41)
    assert (np.diff(iso(grid)) >= 0).all() and np.abs(iso(grid) - 1 / (1 + np.exp(-2 * grid))).mean() < 0.06


def test_learns_words_that_the_fixed_list_lacks():
    r = np.random.default_rng(1)
    clean = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"], r.integers(8, 40))) for _ in range(700)]
    bad = [t + f" grobnak{i}" for i, t in enumerate(clean[:200])]
    texts, y = clean[200:] + bad, np.array([0] * 500 + [1] * 200)
    m = fit(texts, y, r.integers(0, 10, len(texts)))
    assert m.score(["alpha beta grobnakzz gamma " * 5])[0] >= 0.5 > m.score(["alpha beta gamma " * 10])[0]


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    d = fx.awkward(spark, extra=True)
    m = train(d, labels)
    got = scored(d, m).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    kept = without_toxic(d, m)
    assert kept.columns == d.columns and kept.count() == d.count()
    assert without_toxic(fx.texts(spark, (1, "you are a pathetic idiot"), (2, None), (3, "fine")), m).count() == 2
    none = train(fx.empty(spark), labels.limit(0))
    assert scored(fx.empty(spark), none).count() == 0 and without_toxic(fx.empty(spark), none).count() == 0


def test_labelled_texts_do_not_reach_the_driver(spark, monkeypatch):
    """An executor fits the model, the same as of the rows in hand; the driver gets nothing else."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").limit(150) for t in ("documents", "labels"))
    found = d.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").orderBy(F.xxhash64("doc_id")).collect()
    rows = [(r.doc_id, r.text, r.toxic) for r in found if zlib.crc32(str(r.doc_id).encode()) % 5]
    part = [(i * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 10 for i, _, _ in rows]
    want = fit([t for _, t, _ in rows], np.array([int(y > 0) for _, _, y in rows]), np.array(part))

    driver = os.getpid()

    def elsewhere(*of):
        assert os.getpid() != driver
        return fit(*of)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    got = train(d, labels)
    texts = [t for _, t, _ in rows]
    assert len(rows) > 30 and np.allclose(got.score(texts), want.score(texts), atol=1e-6)


def test_disguised_insults_count_wherever_they_stand():
    late = " ".join(f"x{i}y" for i in range(3000)) + " 1d1ot st00pid 1d1ot"
    counts = [x[NAMES.index("leet")] for x in features(["1d1ot st00pid 1d1ot", late], Lexicon())]
    assert counts[0] == counts[1] == 2


@pytest.mark.parametrize("run", ["!", "!1", "@.-", "a.", "a_", "1a", "aaa", "A", "\u00e9!"])
def test_unbroken_runs_take_linear_time(run):
    """Ten megabytes without white space."""
    began = time.time()
    x = features([run * (10_000_000 // len(run.encode()))], Lexicon())
    assert np.isfinite(x).all() and time.time() - began < 60


def test_features_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    texts += ["", "sh1t f*ck w0rd a1 1a 1 ! x!y ab@cd you're YOUR", "\u00c9t\u00e9 TOI \u6f22\u5b57 idiot!idiot", None]
    lexicon = Lexicon({"the": 1.5, "un": 2.0}, {"inte": 1.0, "ment": 3.0})
    leet = dict(zip("013457@$!|+", "oieastasiit", strict=True))
    for text, row in zip(texts, features(texts, lexicon), strict=True):
        got = dict(zip(NAMES, row, strict=True))
        text = text or ""
        words = re.findall(r"[^\W_]+(?:['\u2019][^\W_]+)?", text.lower())
        n, raw = max(1, len(words)), text.encode()
        hits = [lexicon.words[w] for w in words if w in lexicon.words]
        begins = [next(lexicon.starts[w[:k]] for k in (4, 5, 6) if w[:k] in lexicon.starts) for w in words if any(len(w) >= k and w[:k] in lexicon.starts for k in (4, 5, 6))]
        tokens = [t for t in text.split() if any(a in "0123456789@$!|+*#%&" and b.isalpha() for a, b in zip(t, t[1:], strict=False))]
        plain = ["".join(leet.get(c, c) for c in t.lower()) for t in tokens]
        bad = [i for i, w in enumerate(words) if w in INSULTS or w in lexicon.words or any(w[:k] in lexicon.starts for k in (4, 5, 6))]
        you = [i for i, w in enumerate(words) if w in SECOND]
        want = {
            "words": np.log1p(len(words)) if text else 0, "insults": sum(w in INSULTS for w in words), "learnt": len(hits), "learnt_sum": sum(hits), "learnt_max": max(hits, default=0), "starts": len(begins), "starts_sum": sum(begins),
            "second": len(you) / n, "near_second": sum(any(abs(i - j) <= 5 for j in you) for i in bad), "exclaim": text.count("!") / max(1, len(raw)), "question": text.count("?") / max(1, len(raw)),
            "digits": sum(c in "0123456789" for c in text) / max(1, len(raw)), "mixed": len(tokens) / n, "leet": sum(any(p in INSULTS for p in re.findall("[a-z]+", t)) for t in plain),
            "capitals": sum("A" <= c <= "Z" for c in text) / max(1, sum("a" <= c.lower() <= "z" and c.isascii() for c in text)),
        }
        assert {k: round(v, 9) for k, v in want.items()} == {k: round(got[k], 9) for k in want}, text[:80]


def test_the_query_scores_each_text_by_itself(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = train(d, labels)
    got = {r.doc_id: r.score for r in registry.op3_toxicity(spark, "/root/testdata/sf0.01").collect()}
    rows = d.select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(abs(got[r.doc_id] - m.score([r.text])[0]) < 1e-12 for r in rows)
    assert sorted(r.doc_id for r in without_toxic(d, m).collect()) == sorted(k for k, v in got.items() if v < 0.5)


def test_one_method_at_every_size():
    """Without labels the score is the fixed rule; a few labels move it little, many overrule it."""
    clean, bad = ["plain words only here"], ["you pathetic idiot"]
    none = fit([], np.empty(0, int), np.empty(0, int))
    assert none.score(bad)[0] > 0.9 and none.score([*clean, "", None]).max() < 0.1
    few = fit(clean * 3 + bad * 2, np.array([0, 0, 0, 1, 1]), np.arange(5))
    assert few.score(bad)[0] > 0.85 and few.score(clean)[0] < 0.1
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(["alpha", "beta", "jerk", "delta"], 12)) for _ in range(600)]
    many = fit(texts, np.zeros(600, int), r.integers(0, 10, 600))
    assert many.score(texts).max() < 0.5  # "jerk" is no insult in these labels
