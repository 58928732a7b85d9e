"""The byte network against plain Python, finite differences and texts it has not seen."""

import math
import random

import numpy as np
import pytest

from burdenlens.llm import language

SYLLABLES = {
    "xa": ["ba", "ko", "ru", "mi"],
    "xb": ["sch", "ein", "ung", "ver"],
    "xc": ["é", "eau", "oui", "ç"],
}


def text_of(lang, rnd, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(3)
    found = {
        lang: [text_of(lang, rnd, 30).encode()[: language.LEARNED] for _ in range(60)] for lang in SYLLABLES
    }
    return language.fit(found, 60, 24, 1)


def plain(model, window):
    """Probabilities at every position of a window, one unit at a time."""

    def chain(c, data):
        units = c.state.shape[1]
        h = [0.0] * units
        for byte in data:
            g = [float(c.given[k, byte]) for k in range(3 * units)]
            m = [sum(float(c.state[k, j]) * h[j] for j in range(units)) for k in range(3 * units)]
            new = []
            for k in range(units):
                reset = 1 / (1 + math.exp(-(g[k] + m[k])))
                update = 1 / (1 + math.exp(-(g[units + k] + m[units + k])))
                candidate = math.tanh(g[2 * units + k] + reset * m[2 * units + k])
                new.append((1 - update) * candidate + update * h[k])
            h = new
            yield h

    there, back = list(chain(model.forward, window)), list(chain(model.backward, window[::-1]))[::-1]
    out = []
    for a, b in zip(there, back, strict=True):
        logits = [
            float(model.base[k]) + sum(float(w) * x for w, x in zip(model.shown[k], a + b, strict=True))
            for k in range(len(model.languages))
        ]
        total = sum(math.exp(x) for x in logits)
        out.append([math.exp(x) / total for x in logits])
    return out


def test_network_equals_plain_python(model):
    windows = sorted([b"ba koru", b"einung ver", b"x", "é oui".encode()], key=len, reverse=True)
    data, reach = language._columns(windows)
    found = language._chances(model, data, reach)
    for k, w in enumerate(windows):
        assert np.allclose(found[: len(w), :, k], plain(model, w), atol=1e-4)


def test_slopes_equal_differences():
    model = language.fit({"xa": [b"ba"], "xb": [b"ein"], "xc": [b"oui"]}, 0, 3, 2)
    windows = [b"einung ver", b"ba koru", b"x"]
    data, reach = language._columns(windows)
    truth = np.array([1, 0, 2])
    exact = language.Model(
        model.languages,
        *[language.Chain(*[w.astype(np.float64) for w in c]) for c in (model.forward, model.backward)],
        model.shown.astype(np.float64),
        model.base.astype(np.float64),
    )
    slopes, _ = language.gradient(exact, data, reach, truth)
    weights = [*exact.forward, *exact.backward, exact.shown, exact.base]
    rng = np.random.default_rng(1)
    for w, s in zip(weights, slopes, strict=True):
        seen = np.flatnonzero(np.abs(s.ravel()) > 2e-3)
        for k in rng.choice(seen, 4):
            old = w.flat[k]
            w.flat[k] = old + 1e-2
            up = language.gradient(exact, data, reach, truth)[1]
            w.flat[k] = old - 1e-2
            down = language.gradient(exact, data, reach, truth)[1]
            w.flat[k] = old
            assert math.isclose((up - down) / 2e-2, s.flat[k], rel_tol=0.05, abs_tol=2e-4)


def test_whole_texts_are_pooled(spark, model):
    """A text of many windows: every position counts once, with the warm-up its window gives it."""
    rnd = random.Random(5)
    text = text_of("xb", rnd, 150) + " " + text_of("xc", rnd, 40)
    data = text.encode()
    many = -(-len(data) // language.CORE)
    assert many > 3
    total = np.zeros(3)
    for k in range(many):
        start, stop = len(data) * k // many, len(data) * (k + 1) // many
        low, high = max(start - language.MARGIN, 0), min(stop + language.MARGIN, len(data))
        total += np.array(plain(model, data[low:high]))[start - low : stop - low].sum(0)
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    row = language.predict(frame, model, labels=True).head()
    assert row.lang_pred == model.languages[int(total.argmax())]
    assert math.isclose(row.score, total.max() / len(data), abs_tol=1e-4)
    assert sum(r.size for r in row.lang_runs) == len(data)
    assert [r.start for r in row.lang_runs] == list(np.cumsum([0, *[r.size for r in row.lang_runs]])[:-1])


def test_learning_and_odd_rows(spark):
    rnd = random.Random(9)
    rows = [
        (k, text_of(lang, rnd, rnd.randrange(8, 60)), lang, "x", 0.5)
        for k in range(300)
        for lang in [rnd.choice(list(SYLLABLES))]
    ]
    rows += [(400, None, "xa", "x", 0.5), (401, "", "xa", "x", 0.5), (402, "12 !?", "xb", "x", 0.5)]
    rows += [(403, text_of("xa", rnd, 20), None, "x", 0.5), (None, text_of("xb", rnd, 20), "xb", "x", 0.5)]
    rows += [(404, text_of("xc", rnd, 30_000), "xc", "x", 0.5)] + [(405, "sch einung", "xb", "x", 0.5)] * 3
    frame = spark.createDataFrame(rows, "id long, text string, lang string, Lang_Pred string, score double")
    learned = frame.where("id % 3 <> 0 OR id IS NULL")
    model = language.train(learned, fit_rows=256, steps=120, batch=48)
    assert model.languages == ["xa", "xb", "xc"]
    found = language.predict(frame, model).collect()
    assert len(found) == len(rows)
    assert {c.lower() for c in found[0].asDict()} == {"id", "text", "lang", "lang_pred", "score"}
    by_id = {r.id: r for r in found}
    for k in (400, 401, 402):
        assert (by_id[k].lang_pred, by_id[k].score) == ("und", 0.0)
    assert by_id[403].lang_pred == "xa" and by_id[404].lang_pred == "xc" and by_id[None].lang_pred == "xb"
    unseen = [r for r in found if r.id is not None and r.id < 400 and r.id % 3 == 0]
    right = sum(r.lang == r.lang_pred for r in unseen)
    assert right >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in found)


def test_sample_is_bounded(spark):
    """A language with nearly all rows, many of one id, gives no more rows than asked for."""
    frame = spark.range(20_000).selectExpr(
        "IF(id % 3 = 0, 7, id) AS id", "'word ' || id AS text", "IF(id % 100 = 0, 'xb', 'xa') AS lang"
    )
    seen = {}

    def kept(found, *rest):
        seen.update({k: len(v) for k, v in found.items()})

    real, language.fit = language.fit, kept
    try:
        language.train(frame, fit_rows=128, fit_windows=2)
    finally:
        language.fit = real
    assert seen["xa"] == 256 and 100 < seen["xb"] <= 256


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string, lang string")
    model = language.train(none)
    assert language.predict(none, model).collect() == []
    some = spark.createDataFrame([(1, "word")], "id long, text string")
    (row,) = language.predict(some, model, labels=True).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    one = language.train(spark.createDataFrame([(1, "word", "xa")], "id long, text string, lang string"))
    (row,) = language.predict(some, one).collect()
    assert (row.lang_pred, row.score) == ("xa", 1.0)
