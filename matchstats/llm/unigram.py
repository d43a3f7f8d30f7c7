"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and scores come from a public model file. A unigram model's scores are log probabilities and are
taken as they are; a BPE model has merge ranks instead, from which log probabilities follow by Zipf's
law, ``-log(rank + 1) - log(sum of 1 / (rank + 1))``. The trie is a double array over UTF-8 bytes, in
which a space (the marker U+2581 of the model) is byte 0xFF, so that a literal U+2581 in a text stays
different from a space and decoding gives back every text exactly.

A text gets one space in front. As no piece has a marker after another character, and none has a
newline, the best path of a text is the best paths of its units (markers and what follows them, and
newlines) one after the other; the Viterbi recursion runs over many units at a time in numpy, one byte
position after the other, and frequent units are remembered. A character that no piece covers costs
less than any piece and becomes its bytes' pieces.

Encoding is one pass over the rows without a shuffle; the trie is a broadcast of fixed size.

Cases: null text counts as empty (no ids); repeated rows are encoded each by itself; a text of any
length is taken whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import python_workers

MARK, SPACE_BYTE = "▁", 0xFF
#: Units in the memo of a worker, and bytes of a unit in it, at most; bytes of units in one numpy pass.
MEMO_UNITS, MEMO_BYTES, PASS_BYTES = 400_000, 64, 1 << 19
_UNIT = re.compile(rb"\xff+[^\xff\n]*|\n|[^\xff\n]+")


class DoubleArray:
    """Trie over byte strings: from state s, byte c leads to base[s] + c if check of that is s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size, window = 1 << 16, 1 << 9
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], free, todo, at = 0, 1, [(0, tree)], 0
        while at < len(todo):
            state, node = todo[at]
            at += 1
            codes = np.array(sorted(c for c in node if c >= 0), dtype=np.int64)
            value[state] = node.get(-1, -1)
            if not len(codes):
                continue
            while check[free] >= 0:
                free += 1
            since, found = free, np.zeros(0, dtype=np.int64)
            while not len(found):  # the first place where all children fit, a window of free places at a time
                while since + window + 512 >= len(check):
                    grow = len(check)
                    base, check, value = (np.concatenate([x, np.full(grow, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                places = since + np.flatnonzero(check[since : since + window] < 0) - codes[0]
                found = places[(check[places[:, None] + codes] < 0).all(axis=1)]
                since += window
            b = int(found[0])
            base[state] = b
            check[b + codes] = state
            todo += [(b + int(c), node[int(c)]) for c in codes]
        self.base, self.check, self.value = base, check, value


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], skip: set[int], ranks: bool):
        """``pieces``: text and score by id; ``skip``: ids of control and byte pieces; ``ranks``: scores are -rank."""
        own = {i: (p.replace(MARK, "\0").encode().replace(b"\0", b"\xff"), s) for i, (p, s) in enumerate(pieces) if i not in skip}
        if any(b"\n" in p or b"\xff" in p.lstrip(b"\xff") for p, _ in own.values()):
            raise ValueError("a piece goes over a boundary of units")
        self.score = np.zeros(len(pieces))
        total = math.log(sum(1 / (1 - s) for _, s in own.values())) if ranks else 0.0
        for i, (_, s) in own.items():
            self.score[i] = -math.log(1 - s) - total if ranks else s
        self.unknown = min((self.score[i] for i in own), default=0.0) - 10
        self.trie = DoubleArray({p: i for i, (p, _) in own.items()})
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.bytes_of = [own[i][0].replace(b"\xff", b" ") if i in own else b"" for i in range(len(pieces))]
        for c, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([c])
        self.memo: dict[bytes, bytes] = {}

    def digest(self) -> str:
        """Of all that a path depends on: pieces, scores, the score of unknown characters, byte pieces."""
        return hashlib.sha1(repr((self.bytes_of, self.score.tolist(), self.unknown, self.byte_ids.tolist())).encode()).hexdigest()

    # ---- Viterbi

    def best(self, units: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of the best path of each unit."""
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        out: list[bytes] = [b""] * len(units)
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * len(units[order[at + n]]) <= PASS_BYTES:
                n += 1
            group = order[at : at + n]
            for k, ids in zip(group, self._pass([units[k] for k in group]), strict=True):
                out[k] = ids
            at += n
        return out

    def _pass(self, units: list[bytes]) -> list[bytes]:
        lengths = np.array([len(u) for u in units])
        n, longest = len(units), int(lengths.max(initial=0))
        text = np.zeros((longest + 1, n), dtype=np.int64)
        flat = np.frombuffer(b"".join(units), dtype=np.uint8)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[col, row] = flat
        start = (text & 0xC0) != 0x80  # not inside a character
        score = np.full((longest + 1, n), -np.inf)
        piece, back = np.full((longest + 1, n), -1, np.int32), np.zeros((longest + 1, n), np.int32)
        score[0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(longest):
            live = np.flatnonzero((lengths > i) & start[i] & (score[i] > -np.inf))
            if not len(live):
                continue
            # a character by itself, as its bytes
            c = text[i, live]
            size = np.where(c < 0x80, 1, np.where(c < 0xC0, 1, np.where(c < 0xE0, 2, np.where(c < 0xF0, 3, np.where(c == SPACE_BYTE, 1, 4)))))
            end = np.minimum(i + size, lengths[live])
            self._offer(score, piece, back, end, live, score[i, live] + self.unknown, -2, i)
            state, j = np.zeros(len(live), dtype=np.int64), i
            while len(live):
                target = base[state] + text[j, live]
                fits = (check[target] == state) & (target > 0) & (lengths[live] > j)
                live, state = live[fits], target[fits]
                j += 1
                ids = value[state]
                has = np.flatnonzero(ids >= 0)
                if len(has):
                    k = live[has]
                    self._offer(score, piece, back, np.full(len(k), j), k, score[i, k] + self.score[ids[has]], ids[has], i)
        at, paths = lengths.copy(), [[] for _ in range(n)]
        rows = np.arange(n)
        steps = []
        while True:
            live = rows[at[rows] > 0]
            if not len(live):
                break
            steps.append((live, piece[at[live], live], back[at[live], live], at[live].copy()))
            at[live] = back[at[live], live]
            rows = live
        for live, ids, since, until in steps:
            for k, i, a, b in zip(live.tolist(), ids.tolist(), since.tolist(), until.tolist(), strict=True):
                if i >= 0:
                    paths[k].append(i)
                else:
                    paths[k] += [int(self.byte_ids[0x20 if c == SPACE_BYTE else c]) for c in reversed(units[k][a:b])]
        return [np.array(p[::-1], dtype="<i4").tobytes() for p in paths]

    @staticmethod
    def _offer(score, piece, back, end, unit, offered, ids, since) -> None:
        better = offered > score[end, unit]
        end, unit = end[better], unit[better]
        score[end, unit] = offered[better]
        piece[end, unit] = ids[better] if isinstance(ids, np.ndarray) else ids
        back[end, unit] = since

    # ---- texts

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        parts = [_UNIT.findall(b"\xff" + t.replace(b" ", b"\xff")) if t else [] for t in texts]
        seen = set().union(*parts)
        if len(self.memo) + len(seen) > MEMO_UNITS:
            self.memo = {u: self.memo[u] for u in seen if u in self.memo}
        memo = self.memo
        new = [u for u in seen if u not in memo]
        memo.update(zip(new, self.best(new), strict=True))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, p)), dtype="<i4") for p in parts]
        for u in new:
            if len(u) > MEMO_BYTES:
                del memo[u]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: pieces one after the other, markers as spaces, without the space in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:]


def load(path: str) -> tuple:
    """What ``Unigram`` takes, from a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    byte_ids = [m.piece_to_id(f"<0x{c:02X}>") for c in range(256)]
    if not all(m.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte fallback")
    skip = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)}
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(n)]
    # ranks are whole numbers from 0 down; log probabilities are not
    ranks = all(s <= 0 and float(s).is_integer() for i, (_, s) in enumerate(pieces) if i not in skip)
    return pieces, byte_ids, skip, ranks


_MODELS: dict[str, Unigram] = {}


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids, ids_crc32 and round_trip (decoding gives the text) of each row."""
    python_workers(docs.sparkSession)
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    own = Unigram(*load(model))
    shared, key = docs.sparkSession.sparkContext.broadcast(own), own.digest()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if key not in _MODELS:  # with what its memo has from this worker's earlier tasks
            _MODELS[key] = shared.value
        m = _MODELS[key]
        is_byte = np.zeros(len(m.bytes_of), dtype=bool)
        is_byte[m.byte_ids] = True
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = m.encode(texts)
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([m.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "n_byte_pieces", "ids", "ids_crc32", "round_trip"],
            )

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return d.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids array<int>, ids_crc32 long, round_trip boolean")


def op7(docs: DataFrame) -> DataFrame:
    return encoded(docs)
