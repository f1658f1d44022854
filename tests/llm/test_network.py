"""The byte network against plain loops: convolution, maximum, softmax, gradient and the score of whole texts."""

from __future__ import annotations

import math

import numpy as np
import pytest

from swathline.llm import language

SIZE = 12


def network(seed: int = 3) -> language.ByteNetwork:
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(0, 0.5, (w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS]
    shifts = [rng.normal(0, 0.5, language.FILTERS).astype(np.float32) for _ in language.WIDTHS]
    weights = rng.normal(0, 0.5, (language.FILTERS * len(language.WIDTHS), 3)).astype(np.float32)
    return language.ByteNetwork(["de", "en", "fr"], kernels, shifts, weights, rng.normal(0, 0.5, 3).astype(np.float32))


def plain(net: language.ByteNetwork, window: bytes) -> list[float]:
    tops = []
    for table, shift in zip(net.kernels, net.shifts, strict=True):
        for f in range(language.FILTERS):
            values = [sum(float(table[j][window[i + j]][f]) for j in range(len(table))) for i in range(len(window) - len(table) + 1)]
            tops.append(max(0.0, max(values) + float(shift[f])))
    raised = [math.exp(sum(t * float(net.weights[k][c]) for k, t in enumerate(tops)) + float(net.bias[c])) for c in range(3)]
    return [r / sum(raised) for r in raised]


def plain_text(net: language.ByteNetwork, text: str | None) -> tuple[str, float]:
    raw = (text or "").lower().encode("utf-8")
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    sums = [0.0] * 3
    for at in range(0, len(raw), SIZE):
        part = raw[at:at + SIZE]
        for c, p in enumerate(plain(net, part.ljust(SIZE, b"\0"))):
            sums[c] += p * len(part) / len(raw)
    best = max(range(3), key=lambda c: sums[c])
    return net.languages[best], sums[best]


def test_scores_of_whole_texts(spark):
    net = network()
    texts = [None, "", "1234 !", "a", "Ein Feld im Norden", "the field was mapped in one flight", "été à la plage " * 40, "x" * SIZE, "y" * (SIZE + 1), "a"]
    df = spark.createDataFrame([(i, t, "aside") for i, t in enumerate(texts)], "id long, notes string, language string")
    got = {r.id: r for r in language.notes_language(df, net, SIZE).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        name, score = plain_text(net, text)
        assert got[i].language == name and got[i].score == pytest.approx(score, abs=1e-5)
    assert language.notes_language(df.limit(0), net, SIZE).collect() == []


def test_places_of_the_maximum():
    net = network(5)
    windows = np.random.default_rng(1).integers(0, 256, (20, SIZE)).astype(np.uint8)
    top, places = net.features(windows, places=True)
    assert np.allclose(top, net.features(windows))
    for k, (table, spot) in enumerate(zip(net.kernels, places, strict=True)):
        for i in range(len(windows)):
            for f in range(language.FILTERS):
                value = sum(float(table[j][windows[i, spot[i, f] + j], f]) for j in range(len(table))) + float(net.shifts[k][f])
                assert top[i, k * language.FILTERS + f] == pytest.approx(max(0.0, value), abs=1e-4)


def test_one_training_step_goes_down_the_slope():
    """Adam's first step has the size of the rate and the sign of the gradient, which differences of the loss give."""
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(97, 123, (8, SIZE)).astype(np.uint8), np.array([0, 1] * 4)
    rate = 1e-3
    trained = language.train_network(windows, labels, ["a", "b"], rounds=1, batch=8, rate=rate, seed=4)
    start = np.random.default_rng(4)
    kernels = [start.normal(0, 0.1, (w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS]
    weights = start.normal(0, 0.1, (language.FILTERS * len(language.WIDTHS), 2)).astype(np.float32)

    def loss(kernels: list[np.ndarray]) -> float:
        net = language.ByteNetwork(["a", "b"], kernels, [np.zeros(language.FILTERS)] * 3, weights.astype(np.float64), np.zeros(2))
        p = language.softmax(net.features(windows) @ net.weights)
        return float(-np.log(p[np.arange(8), labels]).mean())

    exact, step, checked = [k.astype(np.float64) for k in kernels], 1e-4, 0
    for k, table in enumerate(exact):
        for j, b, f in zip(rng.integers(0, len(table), 60), rng.choice(windows.ravel(), 60), rng.integers(0, language.FILTERS, 60), strict=True):
            own = table[j, b, f]
            table[j, b, f] = own + step
            up = loss(exact)
            table[j, b, f] = own - step
            down = loss(exact)
            table[j, b, f] = own
            slope = (up - down) / (2 * step)
            if abs(slope) > 1e-4:
                moved = float(trained.kernels[k][j, b, f] - kernels[k][j, b, f])
                assert moved == pytest.approx(-rate * np.sign(slope), rel=0.05)
                checked += 1
    assert checked >= 10
