"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an edge for each vocabulary piece (or lone character) between two boundaries. Going forward,
each boundary keeps one backpointer. For a unigram vocabulary it is the piece that ends the best-scoring path. For a
BPE vocabulary it is the last piece of the BPE encoding of the text so far, which is the one piece that is stable next
to the last piece of the encoding before it: a sequence is the BPE encoding exactly if each two neighbours stay apart
when encoded on their own.

Only a window of as many boundaries as the longest piece has characters can still be continued. Whenever the
backpointer paths of all of them go through one boundary, the ids before it are committed and forgotten. Pieces never
cross from a character to a following space mark, so all paths converge there; the ids of short stretches between such
marks are kept and reused, up to a bound. Stretches of any length go through the same search, as many characters at a
time as the longest piece has, so it never holds more than a few such blocks of a stretch, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.llm.staging import give_back_memory, kept_in_worker, let_go_what_others_keep

MARK = "▁"
_IRREGULAR = re.compile(f"  |{MARK}|^ | $|^\\n| \\n")
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Rows encoded at a time.
_ROWS = 500
#: Stretches up to this length are kept for reuse; pairs of ids known to stay apart or not are kept up to this number.
_KEPT_LENGTH, _KEPT_PAIRS, _KEPT_TAILS = 32, 500_000, 10_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def check_inner_marks(pieces: Iterable[str]) -> None:
    """Texts are cut before space marks, which is right only if a piece holds marks at its start alone (or nothing else)."""
    bad = next((p for p in pieces if MARK in p.lstrip(MARK)), None)
    if bad is not None:
        raise ValueError(f"piece {bad!r} holds an inner space mark; texts can't be cut at spaces")


def load_vocabulary(model_file: str) -> dict:
    """Pieces of a model file as plain values (to be broadcast): piece, score and kind by id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kinds = [_BYTE if m.is_byte(i) else _UNKNOWN if m.is_unknown(i) else _CONTROL if m.is_control(i) or m.is_unused(i) else _NORMAL for i in range(m.vocab_size())]
    probe = "͸͹"  # unassigned characters: only a byte vocabulary can spell them
    check_inner_marks(m.id_to_piece(i) for i, k in enumerate(kinds) if k == _NORMAL)
    with open(model_file, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    return {
        "key": key,
        "pieces": [m.id_to_piece(i) for i in range(m.vocab_size())],
        "scores": [m.get_score(i) for i in range(m.vocab_size())],
        "kinds": kinds,
        "bpe": len(m.encode(probe)) > 0 and all(s <= 0 and float(s).is_integer() for s in (m.get_score(i) for i in range(m.vocab_size()))),
    }


class PieceCodec:
    """Encodes and decodes with one vocabulary. ``bpe`` chooses the rule for backpointers."""

    def __init__(self, vocabulary: dict, kept: int = 150_000):
        pieces, kinds = vocabulary["pieces"], vocabulary["kinds"]
        self.bpe = vocabulary["bpe"]
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        self.score = {p: vocabulary["scores"][i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(pieces[i][3:-1], 16): i for i, k in enumerate(kinds) if k == _BYTE}
        self.unknown = next((i for i, k in enumerate(kinds) if k == _UNKNOWN), 0)
        self.by_id = vocabulary["scores"]
        self.worst = min(self.score.values(), default=0.0) - 10.0
        # Decoding: the bytes of each id; control and unknown ids have none.
        self.spelled = [
            bytes([int(p[3:-1], 16)]) if k == _BYTE else p.replace(MARK, " ").encode() if k == _NORMAL else b"" for p, k in zip(pieces, kinds)
        ]
        # One pass of this automaton over a text lists all its edges, (end, (id, characters)), by rising end.
        self.edges = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.edges.add_word(p, (i, len(p)))
        self.edges.make_automaton()
        self.pieces, self.start = pieces, len(pieces)
        self.kept, self.known, self.older, self.apart, self.tails = kept, {}, {}, {}, {}
        # Neighbours inside pieces: any other two characters are a place where all paths converge.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.lines_end = not any("\n" in p for p in self.ids)

    # -- encoding ---------------------------------------------------------------------------------------------------
    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few characters: join the best-scoring neighbours, leftmost first, until none joins."""
        while True:
            best, at = -np.inf, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1], -np.inf)
                if s > best:
                    best, at = s, k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether a piece is stable after another (or at the start, where nothing joins it)."""
        pair = [self.pieces[right]] if left == self.start else [self.pieces[left], self.pieces[right]]
        found = self.apart[left << 32 | right] = self._merged(list("".join(pair))) == pair
        return found

    def segments(self, blocks: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of text blocks; holds a block and about ``longest`` characters that are not yet decided."""
        start, longest, apart, check, bpe = self.start, self.longest, self.apart, self._stays_apart, self.bpe
        text, back, width, total = "", [start], [0], [0.0]  # from the last commit on: for each boundary its backpointer
        edges, fed, done = None, 0, 0  # done: characters committed
        blocks = iter(blocks)
        block = next(blocks, "")
        while block:
            edges = self.edges.iter(block) if edges is None else edges
            if fed:
                edges.set(block)
            text += block
            fed += len(block)
            for end, (piece, n) in edges:
                at = end + 1 - done
                while len(back) < at:  # characters outside the vocabulary: an edge of their own, spelled in bytes
                    back.append(start)
                    width.append(1)
                    total.append(total[-1] + self.worst)
                left = back[at - n]
                if bpe:
                    ok = apart.get(left << 32 | piece)
                    if (check(left, piece) if ok is None else ok):
                        # One candidate at most is stable.
                        back.append(piece)
                        width.append(n)
                        total.append(0.0)
                else:
                    s = total[at - n] + self.by_id[piece]
                    if len(back) == at:
                        back.append(piece)
                        width.append(n)
                        total.append(s)
                    elif s > total[at]:
                        back[at], width[at], total[at] = piece, n, s
            while len(back) <= len(text):
                back.append(start)
                width.append(1)
                total.append(total[-1] + self.worst)
            block = next(blocks, "")
            if not block:
                break
            # Paths from every boundary that can still be continued: where they meet, all before is settled.
            alive = set(range(max(0, len(text) - longest + 1), len(text) + 1))
            while len(alive) > 1:
                top = max(alive)
                alive.discard(top)
                alive.add(top - width[top])
            meet = alive.pop()
            if meet:
                yield from self._path(text, back, width, meet)
                done += meet
                text, back, width, total = text[meet:], back[meet:], [0, *width[meet + 1 :]], total[meet:]
        yield from self._path(text, back, width, len(text))

    def _path(self, text: str, back: list[int], width: list[int], end: int) -> list[int]:
        """Ids from the last commit (boundary 0) to ``end``."""
        out: list[int] = []
        while end > 0:
            if back[end] == self.start:
                out += [self.bytes[b] for b in text[end - 1].encode()[::-1]] if self.bytes else [self.unknown]
            else:
                out.append(back[end])
            end -= width[end]
        return out[::-1]

    @staticmethod
    def _packed(ids: Iterable[int]) -> bytes:
        return array("i", ids).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        """Ids of characters between two places where all paths converge, packed; taken in by the longest piece."""
        step = self.longest
        return self._packed(self.segments(stretch[k : k + step] for k in range(0, len(stretch), step)))

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space (its mark included), or after a line end that the word begins with, packed.

        Closing punctuation is taken apart where no piece joins it to the word. Words are kept in two generations; the
        older one goes when the younger is full.
        """
        packed = self.older.get(word)
        if packed is None:
            k = len(word)
            while k and not word[k - 1].isalnum():
                k -= 1
            if 0 < k < len(word) and word[k - 1 : k + 1] not in self.joined:
                tail = word[k:]
                if tail not in self.tails and len(self.tails) < _KEPT_TAILS and len(tail) <= _KEPT_LENGTH:
                    self.tails[tail] = self._stretch(tail)
                return (self.known.get(word[:k]) or self._word(word[:k])) + (self.tails.get(tail) or self._stretch(tail))
            packed = self._stretch(word if word[:1] == "\n" else MARK + word)
        if len(word) <= _KEPT_LENGTH:
            if len(self.known) >= self.kept:
                self.known, self.older = {}, self.known
                if len(self.apart) > _KEPT_PAIRS:
                    self.apart.clear()
            self.known[word] = packed
        return packed

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; spaces become marks and one mark goes before a text that is not empty."""
        if not text:
            return np.empty(0, dtype="<i4")
        if not self.lines_end or _IRREGULAR.search(text):  # runs of spaces, marks: cut before every run of marks
            parts = [self._stretch(s) for s in _STRETCH.findall(MARK + text.replace(" ", MARK))]
        else:
            make = self._word
            parts = [self.known.get(w) or make(w) for w in text.replace("\n", " \n").split(" ")]
        return np.frombuffer(b"".join(parts), dtype="<i4")

    # -- decoding ---------------------------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces and bytes joined, marks turned to spaces, the leading one dropped."""
        spelled = self.spelled
        raw = b"".join([spelled[i] for i in ids.tolist()])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


#: With its words a codec takes about 120 MB, so the tasks of other operators let it go.
_codecs: dict[str, PieceCodec] = kept_in_worker.setdefault("pieces", {})


def _codec(vocabulary: dict) -> PieceCodec:
    """The codec of this Python worker, with the stretches it has kept from earlier tasks."""
    let_go_what_others_keep("pieces")
    if vocabulary["key"] not in _codecs:
        _codecs.clear()
        _codecs[vocabulary["key"]] = PieceCodec(vocabulary)
    return _codecs[vocabulary["key"]]


def encode_texts(docs: DataFrame, vocabulary: dict, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``ids`` (array<int>), ``n_ids`` and ``round_trip`` (decoding gives the text back), for every row.

    A null or empty text has no ids. A text that holds the space mark itself decodes to a space there, so its
    ``round_trip`` is false. Existing columns of these names are replaced; repeated rows get equal results; an empty
    table gives an empty result. The vocabulary (a fixed file of tens of thousands of pieces) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c not in ("ids", "n_ids", "round_trip")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in (("ids", T.ArrayType(T.IntegerType())), ("n_ids", T.LongType()), ("round_trip", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):  # a few rows at a time: ids of long texts stay few
                part = b.slice(k, _ROWS)
                texts = part.column(at).to_pylist()
                ids = [codec.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                same = pa.array([codec.decode(i) == (t or "") for i, t in zip(ids, texts)])
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(ends).astype("i8")), same], names=schema.names)
        give_back_memory()

    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, vocabulary: dict, ids_col: str = "ids") -> DataFrame:
    """``rows`` plus ``decoded``: the text of each row's ids. Null ids decode to an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for lists in parts:
            yield pd.Series([codec.decode(np.asarray([] if x is None else x, dtype="<i4")) for x in lists], dtype=object)

    return rows.withColumn("decoded", decode(F.col(ids_col)))
