"""SentencePiece BPE encoding and decoding; giant documents by a max-plus parallel scan over chunks.

Merges of a BPE vocabulary are not a best path by scores. But a sequence of pieces is what the merges give exactly if every
two neighbours are what the merges give for their joined text, and there is one such sequence. So the lattice here has a
state for each piece at a place, a transition of weight 0 between neighbours that agree and minus infinity otherwise, and
its best path is the encoding. A chunk's matrix holds the best weight from each state at its left boundary to each state at
its right one; matrices multiply associatively (max, plus), and once a chunk's boundary states are known it is traced back
alone.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import reach, stored, table

#: Characters of a chunk; longer documents are giant ones. Words remembered by a worker, their longest.
CHUNK, CACHE, LONG = 65_536, 500_000, 64
SPACE, NEVER = "▁", -np.inf
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_EDGE = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))

State = tuple[int, int]  # where a piece starts and ends


class Pieces:
    """A BPE model file. No piece may have the space mark behind another character, so that no merge crosses a place where
    a space mark follows something else (an edge); a model without that property is refused."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: self.library.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that reach over the start of a word aren't supported")
        byte = {names[i]: i for i in range(size) if self.library.is_byte(i)}
        self.byte_ids = [byte[f"<0x{b:02X}>"] for b in range(256)]
        self.data = [b""] * size
        for piece, i in self.ids.items():
            self.data[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.data[i] = bytes([b])
        for i in range(size):
            if self.library.is_unknown(i):
                self.data[i] = " ⁇ ".encode()
        self.words: dict[str, tuple[int, ...]] = {}
        self.agrees = lru_cache(500_000)(lambda a, b: self.merge(a + b) == [a, b])
        self.stable = lru_cache(100_000)(lambda a: self.merge(a) == [a])

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by the merges: always the neighbours whose union scores best, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.score]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """Its id, or those of the bytes of a character that the vocabulary lacks."""
        i = self.ids.get(piece)
        return (i,) if i is not None else tuple(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a text from one edge to the next. The library puts a space mark in front, so it gets the rest."""
        ids = self.words.get(word)
        if ids is None:
            if word != SPACE and word[0] == SPACE:
                ids = tuple(self.library.encode(word[1:], num_threads=1))
            else:
                ids = tuple(i for p in self.merge(word) for i in self.piece_ids(p))
            if len(word) <= LONG:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, marked: str) -> list[int]:
        """Ids of a text with space marks that begins and ends at edges."""
        out: list[int] = []
        for ids in map(self.word, _WORD.findall(marked)):
            out += ids
        return out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; first: that they begin the document, whose leading space is the encoder's. Bytes that aren't
        UTF-8 become one replacement character each. A part of a document may be decoded by itself if it begins with no
        continuation byte."""
        text = b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "each_byte")
        begin = next((i for i in ids if self.data[i]), None) if first else None
        return text[1:] if begin is not None and self.data[begin].startswith(b" ") and not self.library.is_unknown(begin) else text

    def states(self, text: str, at: int) -> list[State]:
        """Pieces that start before a place and end there or behind it; one character at least is always a piece."""
        out = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                if end == start + 1 or text[start:end] in self.ids:
                    out.append((start, end))
        return out

    def paths(self, text: str, begin: State, stop: int) -> dict[State, State | None]:
        """Each state that begin leads to, with the state before it, up to those that end at stop or behind it. Within an
        encoding from a given state on, one piece at most ends at a place. An empty state begins at an edge."""
        before: dict[State, State | None] = {begin: None}
        by_end: dict[int, list[State]] = {begin[1]: [begin]}
        for at in range(begin[1], stop):
            for state in by_end.pop(at, ()):
                left = text[state[0] : state[1]]
                for end in range(at + 1, min(len(text), at + self.longest) + 1):
                    right = text[at:end]
                    if (end == at + 1 or right in self.ids) and (at, end) not in before and (self.agrees(left, right) if left else self.stable(right)):
                        before[at, end] = state
                        by_end.setdefault(end, []).append((at, end))
        return before


@lru_cache(2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    """As the model sees it: spaces as marks, and one in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def edges(text: str, low: int, high: int) -> tuple[int, int] | None:
    """The first and the last edge from low to before high."""
    first = _EDGE.search(text, low)
    if first is None or first.start() >= high:
        return None
    at = last = first.start()
    back = high - 1
    while back > at:
        if back < len(text) and text[back] == SPACE and text[back - 1] != SPACE:
            last = back
            break
        back -= 1
    return at, last


def _ends(model: Pieces, text: str, low: int, high: int, begins: bool, ends: bool) -> tuple[list[State], list[State]]:
    """States at the boundaries of the chunk from low to high: the empty one at a document's beginning, those that end
    there at its end."""
    left = [(low, low)] if begins else model.states(text, low)
    right = [s for s in model.states(text, high) if s[1] == high or not ends]
    return left, right


def transfer(model: Pieces, text: str, low: int, high: int, begins: bool, ends: bool) -> np.ndarray:
    """Best weights from each left state to each right state. With an edge between, all paths meet there, and the matrix
    is the sum of a column and a row."""
    left, right = _ends(model, text, low, high, begins, ends)
    out = np.full((len(left), len(right)), NEVER)
    cut = edges(text, low + model.longest, high)
    if cut is None:
        for i, state in enumerate(left):
            reached = model.paths(text, state, high)
            out[i] = [0.0 if s in reached else NEVER for s in right]
        return out
    tail = model.paths(text, (cut[1], cut[1]), high)
    row = np.array([0.0 if s in tail else NEVER for s in right])
    for i, state in enumerate(left):
        if any(s[1] == cut[0] and s != (cut[0], cut[0]) for s in model.paths(text, state, cut[0])):
            out[i] = row
    return out


def trace(model: Pieces, text: str, low: int, high: int, begin: State, end: State) -> list[int]:
    """Ids of the pieces behind state begin, up to state end."""

    def back(before: dict[State, State | None], state: State) -> list[int]:
        held = []
        while before[state] is not None:
            held.append(model.piece_ids(text[state[0] : state[1]]))
            state = before[state]
        return [i for ids in reversed(held) for i in ids]

    cut = edges(text, low + model.longest, high)
    if cut is None:
        return back(model.paths(text, begin, high), end)
    head = model.paths(text, begin, cut[0])
    meet = next(s for s in head if s[1] == cut[0] and s != (cut[0], cut[0]))
    return back(head, meet) + model.encode(text[cut[0] : cut[1]]) + back(model.paths(text, (cut[1], cut[1]), high), end)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the best weight over every state in the middle."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by pairs and pairs of pairs: as many steps as the logarithm of their number."""
    if len(matrices) == 1:
        return matrices
    pairs = prefixes([product(*matrices[k : k + 2]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else product(pairs[k // 2 - 1], matrices[k]))
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The number of the state at each boundary, from the document's beginning to its end, on the best path."""
    ahead = [m[0] for m in prefixes(matrices)]
    states = [int(np.argmax(ahead[-1]))]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(ahead[k - 1] + matrices[k][:, states[-1]])))
    if not np.isfinite(ahead[-1].max()):
        raise ValueError("no path through the chunks")
    return [0, *reversed(states)]


def _cut(path: str):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = 2 * loaded(path).longest
        for pdf in batches:
            for row, doc_id, text in zip(pdf.row, pdf.doc_id, pdf.text, strict=True):
                whole = marked(text)
                starts = range(0, len(whole), CHUNK)
                for n, at in enumerate(starts):
                    low = max(0, at - reach)
                    yield pd.DataFrame({"row": [row], "doc_id": [doc_id], "chunk": [n], "chunks": [len(starts)], "low": [at - low], "high": [min(len(whole), at + CHUNK) - low], "part": [whole[low : at + CHUNK + reach]]}).astype({"doc_id": "Int64"})

    return cut


def _matrices(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for pdf in batches:
            found = [transfer(model, r.part, r.low, r.high, r.chunk == 0, r.chunk == r.chunks - 1) for r in pdf.itertuples()]
            yield pd.DataFrame({"row": pdf.row, "chunk": pdf.chunk, "size": [m.shape[0] for m in found], "matrix": [m.ravel().tolist() for m in found]})

    return run


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk", ignore_index=True)
    states = boundary_states([np.array(m).reshape(n, -1) for m, n in zip(pdf.matrix, pdf["size"], strict=True)])
    return pd.DataFrame({"row": pdf.row, "chunk": pdf.chunk, "left": states[:-1], "right": states[1:]})


def _traces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for pdf in batches:
            ids, same = [], []
            for r in pdf.itertuples():
                left, right = _ends(model, r.part, r.low, r.high, r.chunk == 0, r.chunk == r.chunks - 1)
                begin, end = left[r.left], right[r.right]
                found = trace(model, r.part, r.low, r.high, begin, end)
                ids.append(np.array(found, dtype="<i4").tobytes())
                same.append(model.decode(found, r.chunk == 0) == r.part[begin[1] + (r.chunk == 0) : end[1]].replace(SPACE, " "))
            yield pd.DataFrame({"row": pdf.row, "doc_id": pdf.doc_id.astype("Int64"), "chunk": pdf.chunk, "ids": ids, "same": same})

    return run


def _whole(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for pdf in batches:
            ids = [model.encode(marked(t)) for t in pdf.text]
            same = [model.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, pdf.text, strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "chunks": 1, "ids": [np.array(i, dtype="<i4").tobytes() for i in ids], "round_trip": same})

    return run


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    return pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64").iloc[:1].array, "chunks": [len(pdf)], "ids": [b"".join(pdf.ids)], "round_trip": [bool(pdf.same.all())]})


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, chunks (that the document was cut into), ids (32-bit little-endian) as the
    library gives them for the BPE model at path, round_trip (that decoding gives the text back).

    Null and empty texts have no ids. Repeated rows give repeated rows; giant ones are told apart by a number, not by
    their doc_id. A mark of the model's in a text is a space to it and comes back as one. No documents give no rows. Only
    giant documents are shuffled, chunk by chunk; a group of rows never holds more than one document."""
    reach(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    small = docs.where(F.length("text") < CHUNK).mapInPandas(_whole(path), "doc_id long, chunks int, ids binary, round_trip boolean")
    giant = docs.where(F.length("text") >= CHUNK).withColumn("row", F.monotonically_increasing_id())
    parts = stored(giant.mapInPandas(_cut(path), "row long, doc_id long, chunk int, chunks int, low int, high int, part string").repartition("row", "chunk"), "chunks")
    matrices = parts.mapInPandas(_matrices(path), "row long, chunk int, size int, matrix array<double>")
    states = matrices.groupBy("row").applyInPandas(_scan, "row long, chunk int, left int, right int")
    traces = parts.join(states, ["row", "chunk"]).mapInPandas(_traces(path), "row long, doc_id long, chunk int, ids binary, same boolean")
    return small.unionByName(traces.groupBy("row").applyInPandas(_join, "doc_id long, chunks int, ids binary, round_trip boolean"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, chunks, n_pieces, ids_crc32, round_trip, from encoded, which says what it does with odd
    rows; other columns don't count."""
    import public_tokenizers

    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "chunks", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")
