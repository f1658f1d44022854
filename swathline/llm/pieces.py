"""SentencePiece encoding and decoding as a weighted finite-state transducer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
#: Bounds of a task's stores: bytes of segments already encoded (half of them young, half old; a segment counts with what Python
#: keeps around it), the longest that is kept, and pairs of pieces already tried.
STORE_BYTES, OVERHEAD, LONGEST, PAIRS = 120_000_000, 200, 48, 800_000
#: Notes whose ids and text a task holds at once.
SLICE = 256
_machines: dict[str, Machine] = {}


class Machine:
    """Normaliser, pieces and byte fallback compiled from a model file.

    The normaliser maps a blank to U+2581 and puts one in front of a text that isn't empty.  A piece is an arc that
    reads its characters; a character that is no piece has an arc for its bytes.  In a unigram model an arc weighs
    its negative score and the machine has one state.  In a BPE model the state is the last piece: two pieces
    may follow one another only if merging their characters gives just these two back (weight zero, else
    infinite), and then the one path of finite weight is what the merges give.  The tropical shortest path
    is worked out from left to right.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped blanks is compiled")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError("only unigram and BPE models with byte fallback and without user-defined pieces are compiled")
        self.merges = model.trainer_spec.model_type == BPE
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.weight = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = max(self.weight.values(), default=0.0) + 10
        self.longest = max(map(len, self.ids), default=1)
        self.spelled = [p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
                        else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in model.pieces]
        inside = re.compile(f"[^{BLANK}]{BLANK}")
        self.split = not any(inside.search(p) for p in self.ids) and not any("\n" in p for p in self.ids)
        self.names = [p.piece for p in model.pieces]
        self.pairs: dict[int, bool] = {}
        self.after_blank, self.bare = Store(self, BLANK), Store(self, "")

    def merged(self, s: str) -> list[str]:
        """What merging gives: always the pair of neighbours that makes the piece of the best score, the leftmost first."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                w = self.weight.get(parts[i] + parts[i + 1])
                if w is not None and (best is None or w < best):
                    best, at = w, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may stand after piece ``a``; -1: at the start, or after a character that is no piece."""
        key = a * len(self.spelled) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            both = [self.names[x] for x in (a, b) if x >= 0]
            known = self.pairs[key] = self.merged("".join(both)) == both
        return known

    def shortest(self, s: str) -> list[int]:
        """Ids along the shortest path through the composition of ``s`` with the machine."""
        ids, merges = self.ids, self.merges
        # for each place: the cost of reaching it, the piece that ends there (-1: none, or a character's bytes), and where that began
        cost, last, begun = [0.0] + [math.inf] * len(s), [-1] * (len(s) + 1), [0] * (len(s) + 1)
        pairs, many = self.pairs, len(self.spelled)
        for i in range(1, len(s) + 1):
            low = max(0, i - self.longest)
            for j in range(i - 1, low - 1, -1) if merges else range(low, i):
                piece = ids.get(s[j:i])
                if piece is None:
                    continue
                if merges:
                    # every prefix has one path, so the first piece that may follow is the piece; short ones are tried first
                    follows = pairs.get(last[j] * many + piece)
                    if follows or follows is None and self.may_follow(last[j], piece):
                        cost[i], last[i], begun[i] = 0.0, piece, j
                        break
                elif cost[j] + self.weight[s[j:i]] < cost[i]:
                    cost[i], last[i], begun[i] = cost[j] + self.weight[s[j:i]], piece, j
            if s[i - 1] not in ids and cost[i - 1] + (0.0 if merges else self.unknown) < cost[i]:
                cost[i], last[i], begun[i] = (0.0 if merges else cost[i - 1] + self.unknown), -1, i - 1
        out: list[int] = []
        i = len(s)
        while i:
            j = begun[i]
            out += [last[i]] if last[i] >= 0 else [self.bytes[b] for b in reversed(s[j:i].encode("utf-8", "surrogatepass"))]
            i = j
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers.  No piece spans a line feed or goes on after a blank, so a text is taken in segments."""
        if not text:
            return b""
        if not self.split:
            return np.array(self.shortest(self.prefix + text.replace(" ", BLANK)), "<i4").tobytes()
        if BLANK in text or "  " in self.prefix.replace(BLANK, " ") + text or not self.prefix:
            return b"".join([self.bare[s] for s in re.findall(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n", self.prefix + text.replace(" ", BLANK))])
        out, plain, blank = [], self.bare, self.after_blank
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out += [plain["\n"], plain[words[0]]]
            else:
                out.append(blank[words[0]])
            out += map(blank.__getitem__, words[1:])
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


class Store(dict):
    """Encoded segments; each has ``before`` in front of its key.

    When it is full it becomes the older half, from which what is asked for again comes back.
    """

    def __init__(self, machine: Machine, before: str):
        super().__init__()
        self.machine, self.before, self.older, self.held = machine, before, {}, 0

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = np.array(self.machine.shortest(self.before + key), "<i4").tobytes()
        if len(key) <= LONGEST:
            if self.held >= STORE_BYTES // 2:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = got
            self.held += len(key) + len(got) + OVERHEAD
        return got


def machine(path: str) -> Machine:
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]


def encode_notes(datasets: DataFrame, model: str) -> DataFrame:
    """``datasets`` (id, notes) -> (id, notes, ids array<int>), one row for each row given; no ids for null or empty notes.

    ``model`` is the path of a SentencePiece model file that every executor has.  Repeated rows come out as often as they go in;
    an empty table gives no rows.  Other columns are not looked at.
    """

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = machine(model)
        for batch in texts:
            yield pd.Series([np.frombuffer(own.encode(t), "<i4") for t in batch])

    return datasets.select("id", "notes", encode("notes").alias("ids"))


def decode_notes(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (id, ids) and any other columns -> the same with ``decoded``; empty for null or no ids.

    A text without U+2581 comes back as it was; U+2581 comes back as a blank.
    """

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = machine(model)
        for batch in ids:
            yield pd.Series([own.decode(np.asarray(x)) if x is not None else "" for x in batch], dtype=object)

    return encoded.withColumn("decoded", decode("ids"))


def round_trip_notes(datasets: DataFrame, model: str) -> DataFrame:
    """``datasets`` (id, notes) -> (id, notes, ids, decoded): ``encode_notes`` and ``decode_notes`` in one pass of one Python worker
    for each task, ``SLICE`` notes at a time, so that a task holds one machine and few texts and ids."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [np.frombuffer(own.encode(t), "<i4") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())],
                                                 ["id", "notes", "ids", "decoded"])

    kind = datasets.schema["id"].dataType.simpleString()
    return datasets.select("id", "notes").mapInArrow(both, f"id {kind}, notes string, ids array<int>, decoded string")
