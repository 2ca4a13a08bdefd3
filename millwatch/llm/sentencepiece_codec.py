"""SentencePiece encoding and decoding by a streaming Viterbi search over a piece vocabulary."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millwatch.llm.common import carried

#: The public vocabulary the queries use; any SentencePiece BPE model with byte fallback will do.
MODEL = os.environ.get("LLM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Words, and piece pairs, in one generation of a task's store; it holds two, and a full one replaces the older.
REMEMBERED = 400_000


class Vocabulary:
    """Pieces, ranks and byte pieces of a model file, with the joins a BPE model permits."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                self.byte_id[int(piece[3:5], 16)] = number
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
                self.bytes_of.append(b"" if model.is_control(number) else " ⁇ ".encode())
            else:
                self.id_of[piece] = number
                self.rank[piece] = -model.get_score(number)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.id_of), default=1)
        #: Adjacent characters that some piece holds; between any others there is a boundary in every segmentation.
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.spans_spaces = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.holds_newline = any("\n" in p for p in self.id_of)
        #: Pieces of two characters or more that are segmented into themselves; only these end a path.
        self.valid = {p for p in self.id_of if len(p) > 1 and self.merge(p) == [p]}
        #: By left piece, which right pieces may follow it, as far as known.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.remembered = 0
        #: The valid pieces as a tree of characters; the empty key holds the piece that ends at a node.
        self.tree: dict = {}
        for piece in self.valid:
            node = self.tree
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = piece

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the best-ranked join first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == np.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def adjoin(self, left: str, right: str) -> bool:
        """True if a segmentation may have ``right`` after ``left``: joined, they are segmented into just these two."""
        if self.remembered >= REMEMBERED:
            for known in self.pairs.values():
                known.clear()
            self.remembered = 0
        self.remembered += 1
        found = self.pairs.setdefault(left, {})[right] = self.merge(left + right) == [left, right]
        return found

    def ids(self, piece: str) -> list[int]:
        found = self.id_of.get(piece)
        if found is not None:
            return [found]
        coded = [self.byte_id.get(b) for b in piece.encode()]
        return [self.unknown] if None in coded else coded  # type: ignore[list-item]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class StreamingViterbi:
    """Segments a stream of characters, holding a window bounded by the longest piece and the open paths.

    The path score of a BPE model is all or nothing: a path survives at a position if each of its pieces adjoins the one
    before. One path survives per position; its last piece is the position's backpointer. Whenever the paths of all
    positions that a later piece may start from pass through one boundary, the pieces before it are committed.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.text = ""  # characters from the last committed boundary on
        self.last: list[str] = [""]  # the surviving path's last piece at each position reached so far
        self.before = ""  # the piece that ends at the committed boundary
        self.done = 0  # positions whose outgoing pieces have been followed

    def feed(self, characters: str) -> Iterator[str]:
        step = 2 * self.vocab.longest
        for at in range(0, len(characters), step):
            self.text += characters[at : at + step]
            self._extend(len(self.text) - self.vocab.longest)
            if self.done >= 2 * step:
                yield from self._commit()

    def _extend(self, until: int) -> None:
        """Follow the pieces that start at each position before ``until``; the text must hold all of them."""
        vocab, last, text = self.vocab, self.last, self.text
        tree, pairs = vocab.tree, vocab.pairs
        if len(last) <= len(text):
            last += [""] * (len(text) + 1 - len(last))
        for start in range(self.done, until):
            left = last[start] if start else self.before
            follows = pairs.get(left)
            if follows is None:
                follows = pairs[left] = {}
            node, end = tree, start
            for char in text[start : start + vocab.longest]:
                end += 1
                node = node.get(char)
                piece = char if end == start + 1 else node.get("") if node else None
                if piece and not last[end]:
                    fits = follows.get(piece) if left else True
                    if vocab.adjoin(left, piece) if fits is None else fits:
                        last[end] = piece
                if not node:
                    break
        self.done = max(self.done, until)

    def _commit(self) -> Iterator[str]:
        """Yield the pieces before the last boundary that the paths of all open positions share."""
        # A later piece starts at an unfollowed position; the pieces that end there have all been seen up to ``done``.
        ends = {at for at in range(self.done, len(self.text) + 1) if self.last[at]}
        while len(ends) > 1:  # step the longest path back until all meet
            far = max(ends)
            ends.remove(far)
            ends.add(far - len(self.last[far]))
        yield from self._cut(ends.pop())

    def _cut(self, at: int) -> Iterator[str]:
        pieces, to = [], at
        while to > 0:
            pieces.append(self.last[to])
            to -= len(self.last[to])
        if pieces:
            self.before = pieces[0]
            self.text, self.last, self.done = self.text[at:], ["", *self.last[at + 1 :]], max(0, self.done - at)
            yield from reversed(pieces)

    def finish(self) -> Iterator[str]:
        self._extend(len(self.text))
        yield from self._cut(len(self.text))
        self.before = ""


class Codec:
    """Encodes and decodes whole texts; repeated words are segmented once."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Where no piece crosses a blank or a line feed, all paths meet there: each word is searched alone.
        plain = not self.vocab.spans_spaces and not self.vocab.holds_newline
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if plain else r"(?s).+")

    def _remember(self, text: str, found: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[text] = found
        return found

    def _searched(self, text: str) -> bytes:
        search, ids = StreamingViterbi(self.vocab), []
        if len(text) <= self.vocab.longest:
            search.text = text  # within one window: nothing to commit before the end
        else:
            for piece in search.feed(text):
                ids += self.vocab.ids(piece)
        for piece in search.finish():
            ids += self.vocab.ids(piece)
        return np.array(ids, np.int32).tobytes()

    def _segment(self, word: str) -> bytes:
        """Search a word; at boundaries that every segmentation has, its parts are searched or known alone."""
        found = self.older.get(word)
        if found is not None:
            return self._remember(word, found)
        inside, known, older, parts, at = self.vocab.inside, self.known, self.older, [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in inside:
                part, at = word[at:i], i
                found = known.get(part) or older.get(part)
                if found is None:
                    found = self._searched(part) if len(part) > 1 else np.array(self.vocab.ids(part), np.int32).tobytes()
                    if len(part) < len(word):
                        self._remember(part, found)
                parts.append(found)
        return self._remember(word, parts[0] if len(parts) == 1 else b"".join(parts))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._segment(w) if f is None else f for w, f in zip(words, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        joined = b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return joined[1:] if joined.startswith(" ") else joined


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [None if t is None else coder.encode(t) for t in texts]
            lengths = np.array([0 if i is None else len(i) for i in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            flat = np.concatenate([i for i in ids if i is not None] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([i is None for i in ids]))
            columns, names = [*batch.columns, lists, pa.array(lengths)], [*batch.schema.names, "ids", "n_ids"]
            if back:
                # The model writes U+2581 for a blank, so that character itself comes back as a blank.
                same = [None if t is None else coder.decode(i.tolist()) == t.replace(SPACE, " ") for t, i in zip(texts, ids)]
                columns.append(pa.array(same, pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``n_ids long``, the ids of ``text`` under a SentencePiece BPE model.

    Equal to the ids of the sentencepiece library: the surviving path at each position is the BPE segmentation of the
    text so far. Characters outside the vocabulary become byte pieces. With ``check``, ``round_trip`` tells whether the ids
    decode to the text again (U+2581 read as a blank).

    A null text has null ids and ``n_ids`` 0; an empty one has no ids. Texts are never cut. Rows are independent: repeated
    ones and those with a null doc_id get their own ids. An empty table gives an empty result. Input columns named like a new one,
    in any case, are replaced. ``model`` is a path that every executor can read.
    """
    new = ["ids", "n_ids", *(["round_trip"] if check else [])]
    packed, columns = carried(docs, ("ids", "n_ids", "round_trip"))
    row = packed.schema["__row"].dataType.simpleString()
    kinds = {"ids": "array<int>", "n_ids": "long", "round_trip": "boolean"}
    done = packed.mapInArrow(_encoded(model, check), f"__row {row}, text string" + "".join(f", {n} {kinds[n]}" for n in new))
    return done.select(*columns, *new)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [None if i is None else coder.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with ``decoded string``, the text of ``ids array<int>``; null ids give null. An input ``decoded`` is replaced."""
    packed, columns = carried(rows, ("decoded",), ("ids",))
    row = packed.schema["__row"].dataType.simpleString()
    return packed.mapInArrow(_decoded(model), f"__row {row}, ids array<int>, decoded string").select(*columns, "decoded")
