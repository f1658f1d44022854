"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """One-hot bytes, filters of several widths, maximum over the window, softmax.

    ``kernels``: for each width and each place in it a table (byte -> value of every filter).
    """

    languages: list[str]
    kernels: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def features(self, windows: np.ndarray, places: bool = False):
        """Largest value of every filter in each window (and where it stands)."""
        tops, at = [], []
        for table in self.kernels:
            width = len(table)
            n = windows.shape[1] - width + 1
            total = table[0][windows[:, :n]]
            for j in range(1, width):
                total += table[j][windows[:, j:j + n]]
            if places:
                spot = total.argmax(1)
                at.append(spot)
                tops.append(np.take_along_axis(total, spot[:, None], 1)[:, 0])
            else:
                tops.append(total.max(1))
        top = np.concatenate([t + s for t, s in zip(tops, self.shifts, strict=True)], 1)
        return (np.maximum(top, 0), at) if places else np.maximum(top, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), 128):  # a slice's filter values stay in the processor's cache
            out[i:i + 128] = softmax(self.features(windows[i:i + 128]) @ self.weights + self.bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_network(windows: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 12,
                  batch: int = 64, rate: float = 0.003, seed: int = 7) -> ByteNetwork:
    """Adam on the cross entropy, classes weighted alike; the gradient of a maximum goes to where it stands."""
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    net = ByteNetwork(languages, kernels, shifts, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
                      np.zeros(len(languages), np.float32))
    share = np.bincount(labels, minlength=len(languages)).clip(1)
    weight = (len(labels) / len(languages) / share).astype(np.float32)
    params = [*kernels, *shifts, net.weights, net.bias]
    mean, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            x, y = windows[pick], labels[pick]
            top, at = net.features(x, places=True)
            slope = softmax(top @ net.weights + net.bias)
            slope[np.arange(len(y)), y] -= 1
            slope *= weight[y][:, None] / len(y)
            back = (slope @ net.weights.T) * (top > 0)
            grads, moves = [], []
            for k, (table, spot) in enumerate(zip(kernels, at, strict=True)):
                g = back[:, k * FILTERS:(k + 1) * FILTERS]
                grad = np.zeros_like(table)
                column = np.broadcast_to(np.arange(FILTERS), spot.shape)
                for j in range(len(table)):
                    np.add.at(grad[j], (np.take_along_axis(x, spot + j, 1), column), g)
                grads.append(grad)
                moves.append(g.sum(0))
            grads = [*grads, *moves, top.T @ slope, slope.sum(0)]
            t += 1
            for p, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return net


def cut_windows(raw: bytes, size: int) -> np.ndarray:
    """The bytes in windows of ``size``, the last one filled up with zero bytes; none for an empty text."""
    n = -(-len(raw) // size)
    return np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def plain_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def training_windows(datasets: DataFrame, size: int = 192, most: int = 1024, per_note: int = 2) -> DataFrame:
    """``datasets`` (id, notes, language) -> (language, window): at most ``most`` notes of each language, those with the
    lowest hash of id and text, and of each ``per_note`` windows at even distances over its whole text.

    A language's notes are ranked inside 64 slices of the hash, so a language with most of the rows is not one task's work.
    """
    keyed = datasets.where("notes IS NOT NULL AND language IS NOT NULL AND notes != ''").select(
        "language", "notes", F.xxhash64(F.col("id").cast("string"), "notes").alias("_h"))
    slices = keyed.select("language", "_h").withColumn("_s", F.pmod("_h", F.lit(64)))
    rank = F.row_number().over(W.partitionBy("language", "_s").orderBy("_h"))
    chosen = slices.withColumn("_r", rank).where(F.col("_r") <= most // 64).select("language", "_h").distinct()

    @F.pandas_udf("array<binary>")
    def windows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                own = cut_windows(plain_bytes(text), size)
                out.append([own[i].tobytes() for i in sorted({int(x) for x in np.linspace(0, len(own) - 1, per_note)})])
            yield pd.Series(out)

    return keyed.join(chosen, ["language", "_h"], "left_semi").select("language", F.explode(windows("notes")).alias("window"))


def fit_language_network(datasets: DataFrame, size: int = 192, most: int = 1024, per_note: int = 2, rounds: int = 12) -> ByteNetwork:
    """A network trained on the labelled rows of ``datasets`` (id, notes, language).

    What comes to the driver is bounded by ``most`` notes and ``per_note`` windows of ``size`` bytes for each language.  Without
    any labelled note the network knows no language, and every prediction is ``und``.
    """
    return network_of(learned_windows(datasets, size, most, per_note), size, rounds)


def learned_windows(datasets: DataFrame, size: int = 192, most: int = 1024, per_note: int = 2) -> list[tuple[str, bytes]]:
    return sorted((r.language, bytes(r.window)) for r in training_windows(datasets, size, most, per_note).collect())


def network_of(rows: list[tuple[str, bytes]], size: int = 192, rounds: int = 12) -> ByteNetwork:
    languages = sorted({r[0] for r in rows})
    if not rows:
        return ByteNetwork([], [], [], np.zeros((0, 0)), np.zeros(0))
    windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, size)
    labels = np.array([languages.index(r[0]) for r in rows])
    return train_network(windows, labels, languages, rounds)


#: Bytes for trigrams: a to z and the bytes of other alphabets are told apart, all others are one.
FOLDED = np.array([b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in range(256)], np.int32)
RADIX = 155
DIGIT = re.compile(rb"[0-9]")


def trigrams(raw: bytes) -> np.ndarray:
    """A number for every three bytes in a row of which two are letters or more."""
    x = FOLDED[np.frombuffer(raw, np.uint8)]
    if len(x) < 3:
        return np.zeros(0, np.int32)
    some = (x[:-2] > 0).astype(np.int8) + (x[1:-1] > 0) + (x[2:] > 0)
    return ((x[:-2] * RADIX + x[1:-1]) * RADIX + x[2:])[some >= 2]


@dataclass
class KnownTrigrams:
    """The trigrams of all learned windows, and for each language the share of them that a text of it has (``usual``) and needs (``needed``)."""

    numbers: np.ndarray
    usual: dict[str, float]
    needed: dict[str, float]

    def table(self) -> np.ndarray:
        out = np.zeros(RADIX ** 3, bool)
        out[self.numbers] = True
        return out

    def fits(self, raw: bytes, language: str, table: np.ndarray) -> bool:
        """Whether ``raw`` has no fewer known trigrams than needed, less what chance (four standard deviations) takes from a short text.

        A text that fails is judged again without its words with digits (keys, numbers, addresses).
        """
        own = trigrams(raw)
        return not len(own) or self._enough(own, language, table) or self._enough(
            trigrams(b" ".join(w for w in raw.split() if not DIGIT.search(w))), language, table)

    def _enough(self, own: np.ndarray, language: str, table: np.ndarray) -> bool:
        usual = self.usual[language]
        return len(own) > 0 and table[own].mean() >= self.needed[language] - 4 * np.sqrt(usual * (1 - usual) / len(own))


def known_trigrams(rows: list[tuple[str, bytes]], low: float = 0.01) -> KnownTrigrams:
    """Calibrated on the learned windows (language, window) themselves, each judged by the trigrams of all the others.

    What is usual in a language is the ``low`` quantile of its windows' shares.  Windows with their bytes shuffled stand for what is
    not language: a text may fall a third of the way to their median (secrets, addresses and junk in it), not more.  So the rule
    depends neither on the number of languages nor on the network.
    """
    own = [np.unique(trigrams(w)) for _, w in rows]
    numbers, windows = np.unique(np.concatenate([*own, np.zeros(0, np.int32)]), return_counts=True)
    known, elsewhere = np.zeros((2, RADIX ** 3), bool)
    known[numbers], elsewhere[numbers[windows > 1]] = True, True
    rng = np.random.default_rng(7)
    usual, needed = {}, {}
    for language in sorted({r[0] for r in rows}):
        own_windows = [w for name, w in rows if name == language]
        right = [elsewhere[t].mean() for t in map(trigrams, own_windows) if len(t)]
        mixed = [known[t].mean() for t in (trigrams(rng.permutation(np.frombuffer(w, np.uint8)).tobytes()) for w in own_windows) if len(t)]
        usual[language] = float(np.quantile(right, low)) if right else 0.0
        needed[language] = usual[language] - max(0.0, usual[language] - float(np.median(mixed or [0.0]))) / 3
    return KnownTrigrams(numbers, usual, needed)


def language_udf(net: ByteNetwork, size: int = 192, known: KnownTrigrams | None = None):
    """Text -> (language, score): the mean of the windows' probabilities, each window with its share of the bytes.

    With ``known``, a text that has too few known trigrams for the language of its highest score is ``und`` with score 0.
    """

    @F.pandas_udf("language string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = known.table() if known else None
        for batch in texts:
            names, scores = [], []
            for lo in range(0, len(batch), 256):
                raws = [plain_bytes(t) if t is not None and any(map(str.isalpha, t)) and net.languages else b""
                        for t in batch.iloc[lo:lo + 256]]
                sums = _pooled(net, raws, size)
                for raw, row in zip(raws, sums, strict=True):
                    name = net.languages[int(row.argmax())] if raw else UNKNOWN
                    if raw and known and not known.fits(raw, name, table):
                        name = UNKNOWN
                    names.append(name)
                    scores.append(float(min(1.0, row.max())) if name != UNKNOWN else 0.0)
            yield pd.DataFrame({"language": names, "score": scores})

    return predict


def _pooled(net: ByteNetwork, raws: list[bytes], size: int) -> np.ndarray:
    """Weighted mean of the windows' probabilities of each text; at most 4096 windows are worked on at once."""
    sums = np.zeros((len(raws), max(1, len(net.languages))))
    owners, parts, held = [], [], 0

    def work() -> None:
        if parts:
            p = net.probabilities(np.concatenate(parts))
            share = np.concatenate([s for _, s in owners])
            np.add.at(sums, np.concatenate([np.full(len(s), i) for i, s in owners]), p * share[:, None])
        owners.clear()
        parts.clear()

    for i, raw in enumerate(raws):
        for at in range(0, len(raw), 4096 * size):
            own = cut_windows(raw[at:at + 4096 * size], size)
            share = np.full(len(own), size, float)
            share[-1] = len(raw[at:at + 4096 * size]) - size * (len(own) - 1)
            parts.append(own)
            owners.append((i, share / len(raw)))
            held += len(own)
            if held >= 4096:
                work()
                held = 0
    work()
    return sums


def notes_language(datasets: DataFrame, net: ByteNetwork, size: int = 192) -> DataFrame:
    """``datasets`` (id, notes) -> (id, language, score), one row for each row given.

    Only ``notes`` is looked at.  ``language`` is one of the network's, or ``und`` with score 0 when notes is null or has no
    letter.  Repeated rows come out as often as they go in; an empty table gives no rows.
    """
    return datasets.select("id", language_udf(net, size)("notes").alias("_p")).select("id", "_p.language", "_p.score")
