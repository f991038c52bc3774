"""SentencePiece encoding and decoding as a max-plus parallel scan.

A segmentation is a path through the lattice of vocabulary pieces that match a text. Edges have
weights in the max-plus semiring: in a unigram model a piece's score, in a BPE model 0 if two
neighbouring pieces are stable together (merging their characters in the model's order gives the
two again) and minus infinity otherwise. Merging is the case: sums of a BPE model's scores, which
are only ranks, give other pieces than its merges do, while a path of stable neighbours is the
merges' result. ``Vocabulary`` serves both kinds.

Texts of up to CHUNK characters are encoded where they are. Longer ones are cut into chunks at any
place. The state at a cut is the piece that covers it or ends there; each chunk gives a transfer
matrix (weight of the best path from each state at its left to each at its right), matrices are
combined associatively, first in blocks of BLOCK chunks, then the blocks of a text, and once the
states at all cuts are known, every chunk is traced back on its own. Inside a chunk no piece crosses
the start of a word (no piece holds a blank after another character), a line feed, or the end of
a run of letters (if no piece goes on from a letter with anything but letters), so whole words
are segmented on their own, by merging if they are short (the path of stable neighbours is what
merging leaves), and remembered for a while.

A blank is U+2581 in pieces and one stands before each text, as in the model. Characters without a
piece become byte pieces. A U+2581 in a text also becomes bytes, so that decoding gives every text
back exactly. Null and empty texts have no pieces. Repeated rows get the same pieces; a null doc_id
is as good as any.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK, REMEMBERED, PORTION = 1 << 16, 64, 50_000, 1 << 18
#: Stands for a U+2581 of the text itself; no decoded text holds it.
OWN_BLANK = "\udc00"
NEVER = -math.inf
LAST = 1 << 60
NO_RANK = np.iinfo(np.int32).max
#: Words of up to so many characters are merged together.
WIDTHS = (0, 4, 8, 12, 16, 24, 32, 63)


def normalise(text: str) -> str:
    return "▁" + text.replace("▁", OWN_BLANK).replace(" ", "▁") if text else ""


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: str  # per piece: n(ormal), b(yte) or - (never matched)
    bpe: bool = True
    ids: dict[str, int] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == "n"}
        self.longest = max(map(len, self.ids), default=1)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == "b"}
        # Where no piece goes on from a letter with anything but letters, a text can be cut there.
        if any(x.isalpha() and not c.isalpha() for p in self.ids for x, c in zip(p, p[1:], strict=False)):
            self.word = re.compile("\n|▁*[^▁\n]+|▁+")
        else:
            own = "".join(sorted({c for p in self.ids for c in p if not c.isalpha() and re.match(r"[^\W\d_]", c)}))  # such as superscripts
            letter = rf"[^\W\d_{own}]"
            self.word = re.compile(rf"▁*{letter}+|\n|▁*(?:[^\w▁\n]|[\d_{own}])+{letter}*|▁+")
        self.reach: dict[str, int] = {}  # length of the longest piece by its first character
        for p in self.ids:
            self.reach[p[0]] = max(len(p), self.reach.get(p[0], 0))
        self.letters = {p: i for p, i in self.ids.items() if len(p) == 1}
        #: What two neighbouring pieces merge into, and the place of that among all merges (the same for equal scores).
        self.joined = {(a, b): i for p, i in self.ids.items() if self.bpe for k in range(1, len(p)) if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None}
        order = {x: r for r, x in enumerate(sorted({-self.scores[i] for i in self.joined.values()}))}
        self.rank = {pair: order[-self.scores[i]] for pair, i in self.joined.items()}
        self.whole: dict[int, bool] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if k == "b" else p.replace("▁", " ").encode() if k == "n" else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        if len(self.byte) != 256 or any("▁" in p.lstrip("▁") for p in self.ids) or any("\n" in p and p != "\n" for p in self.ids):
            raise ValueError("the vocabulary must have all bytes, and no piece may go on after a word or line")

    @classmethod
    def load(cls, path: str = MODEL, bpe: bool = True) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = range(m.vocab_size())
        kinds = "".join("b" if m.is_byte(i) else "-" if m.is_unknown(i) or m.is_control(i) or m.is_unused(i) else "n" for i in n)
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], kinds, bpe)

    # Pieces at a place. A character without a piece is a piece of its own, numbered past the vocabulary.

    def matches(self, text: str, at: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that begin there, longest first."""
        out = [(n, i) for n in range(min(self.reach.get(text[at], 0), len(text) - at), 0, -1) if (i := self.ids.get(text[at : at + n])) is not None]
        return out if text[at] in self.ids else [*out, (1, len(self.pieces) + ord(text[at]))]

    def length(self, piece: int) -> int:
        return len(self.pieces[piece]) if piece < len(self.pieces) else 1

    def emit(self, piece: int) -> tuple[int, ...]:
        if piece < len(self.pieces):
            return (piece,)
        c = chr(piece - len(self.pieces))
        return tuple(self.byte[b] for b in ("▁" if c == OWN_BLANK else c).encode("utf-8", "replace"))

    def weight(self, before: int | None, piece: int) -> float:
        """Of the edge to a piece from the one before."""
        if piece >= len(self.pieces):
            return 0.0 if self.bpe else min(self.scores) - 10.0
        if not self.bpe:
            return self.scores[piece]
        if (ok := self.whole.get(piece)) is None:
            ok = self.whole[piece] = self.merge(self.pieces[piece]) == [piece]
        if not ok or before is None or before >= len(self.pieces):
            return 0.0 if ok else NEVER
        if (ok := self.stable.get((before, piece))) is None:
            if len(self.stable) > REMEMBERED:
                self.stable.clear()
            ok = self.stable[before, piece] = self.merge(self.pieces[before] + self.pieces[piece]) == [before, piece]
        return 0.0 if ok else NEVER

    def merge(self, text: str) -> list[int]:
        """Pieces of a short text by merging, best score first and leftmost among equals."""
        rank = self.rank.get
        ids = list(map(self.letters.get, text))
        if None in ids:
            ids = [len(self.pieces) + ord(c) if i is None else i for c, i in zip(text, ids, strict=True)]
        places = list(map(rank, zip(ids, ids[1:], strict=False), repeat(LAST)))
        while places and (best := min(places)) != LAST:
            at = places.index(best)
            piece = ids[at] = self.joined[ids[at], ids.pop(at + 1)]
            del places[at]
            if at:
                places[at - 1] = rank((ids[at - 1], piece), LAST)
            if at < len(places):
                places[at] = rank((piece, ids[at + 1]), LAST)
        return ids

    @cached_property
    def segmenter(self) -> Segmenter:
        """One for all tasks of a Python process, which goes on with the words of the tasks before."""
        return Segmenter(self)

    # Whole words.

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a word, which no piece enters or leaves."""
        out = self.units.get(text)
        if out is None:
            out = self.older.get(text)
            if out is None:
                path = self.trace(text, None, 0, len(text), None) if not self.bpe else self.merge(text) if len(text) < 64 else self._search(text)
                n = len(self.pieces)
                out = tuple(path) if max(path) < n else tuple(x for p in path for x in self.emit(p))
            if len(text) < 64:
                if len(self.units) >= REMEMBERED:  # what the last so many words had stays
                    self.older, self.units = self.units, {}
                self.units[text] = out
        return out

    def _search(self, text: str) -> list[int]:
        """The path of stable neighbours: longest piece first, back where it ends nowhere."""
        path: list[int] = []
        tries = [iter(self.matches(text, 0))]
        places = [0]
        while tries:
            for n, piece in tries[-1]:
                if self.weight(path[-1] if path else None, piece) != NEVER:
                    path.append(piece)
                    at = places[-1] + n
                    if at == len(text):
                        return path
                    places.append(at)
                    tries.append(iter(self.matches(text, at)))
                    break
            else:
                tries.pop()
                places.pop()
                if path:
                    path.pop()
        raise ValueError(f"no path of stable pieces: {text!r}")

    def encode(self, text: str | None) -> list[int]:
        return self._encode(normalise(text or ""))

    def _encode(self, text: str) -> list[int]:
        out: list[int] = []
        get = self.units.get
        for u in self.word.findall(text):
            ids = get(u)
            if ids is None:
                ids = self.unit(u)
                get = self.units.get
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]

    # Chunks. A state is (characters before the cut, piece); None is the start of a text or word.

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces that begin before a cut and end there or later."""
        return [(cut - s, p) for s in range(max(0, cut - self.longest), cut) for n, p in self.matches(text, s) if s + n >= cut]

    def _walk(self, text: str, entries: list, a: int, z: int) -> tuple[dict, dict]:
        """Best paths from each entry state at a over pieces that begin before z: ends[place][piece, start] = {entry: (weight, piece and start before)}."""
        ends: dict[int, dict] = {}
        for k, state in enumerate(entries):
            at, key = (a, (None, a)) if state is None else (a - state[0] + self.length(state[1]), (state[1], a - state[0]))
            ends.setdefault(at, {}).setdefault(key, {})[k] = (0.0, None)
        for at in range(a, z):
            if at not in ends:
                continue
            for n, piece in self.matches(text, at):
                for before, reached in ends[at].items():
                    w = self.weight(before[0], piece)
                    if w == NEVER:
                        continue
                    into = ends.setdefault(at + n, {}).setdefault((piece, at), {})
                    for k, (v, _) in reached.items():
                        if k not in into or v + w > into[k][0]:
                            into[k] = (v + w, before)
        return ends

    def transfer(self, text: str, entries: list, a: int, z: int) -> dict[tuple[int, tuple], float]:
        """Weights (entry, exit state at z) of the best paths over [a, z)."""
        out: dict[tuple[int, tuple], float] = {}
        for at, nodes in self._walk(text, entries, a, z).items():
            if at >= z:
                for (piece, start), reached in nodes.items():
                    if start < z and piece is not None:
                        for k, (w, _) in reached.items():
                            out[k, (z - start, piece)] = max(w, out.get((k, (z - start, piece)), NEVER))
        return out

    def trace(self, text: str, entry, a: int, z: int, leave) -> list[int]:
        """Pieces that begin in [a, z) on the best path from an entry state to an exit state, or to exactly z if that is None."""
        ends = self._walk(text, [entry], a, z)
        if leave is None:
            node = max((r[0][0], key) for key, r in ends[z].items())[1]
            at = z
        else:
            node, at = (leave[1], z - leave[0]), z - leave[0] + self.length(leave[1])
        out = []
        while node is not None and node[1] >= a and node[0] is not None:
            out.append(node[0])
            node, at = ends[at][node][0][1], node[1]
        return out[::-1]


class Pairs:
    """What neighbouring pieces merge into, as a hash table for whole arrays of pairs."""

    def __init__(self, v: Vocabulary):
        a, b = np.array(list(v.joined), dtype=np.int64).reshape(-1, 2).T
        keys, piece, rank = (a << 32) | b, np.array(list(v.joined.values()), dtype=np.int32), np.array([v.rank[k] for k in v.joined], dtype=np.int32)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.piece, self.rank = np.zeros(1 << self.bits, dtype=np.int32), np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.key[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            own = left[free[first]]
            self.key[slots], self.piece[slots], self.rank[slots] = keys[own], piece[own], rank[own]
            stay = np.ones(len(left), dtype=bool)
            stay[free[first]] = False
            left, at = left[stay], self._next(at[stay])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; that of a pair which does not merge has rank NO_RANK."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = self._slot(keys)
        left = np.flatnonzero((self.key[at] != keys) & (self.key[at] != -1))
        while len(left):
            at[left] = self._next(at[left])
            left = left[(self.key[at[left]] != keys[left]) & (self.key[at[left]] != -1)]
        return at


class Segmenter:
    """Segments the different words of a batch together; those of the last REMEMBERED words are looked up."""

    def __init__(self, v: Vocabulary):
        self.v, self.pairs = v, Pairs(v) if v.bpe else None
        self.first = len(v.pieces) + np.arange(0x110000, dtype=np.int32)
        self.first[[ord(c) for c in v.letters]] = list(v.letters.values())
        self._forget()

    def _forget(self) -> None:
        self.known, self.store = {}, pa.array([], pa.list_(pa.int32()))

    def words(self, words: list[str]) -> pa.ListArray:
        """Ids of each of some different words."""
        if len(self.known) > REMEMBERED:
            self._forget()
        at = list(map(self.known.get, words))
        new = [w for w, i in zip(words, at, strict=True) if i is None]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.store = pa.concat_arrays([self.store, self._segment(new)])
            at = list(map(self.known.get, words))
        return pc.take(self.store, pa.array(at, pa.int32()))

    def _segment(self, words: list[str]) -> pa.ListArray:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if self.pairs is None:
            return pa.array([self.v.unit(w) for w in words], pa.list_(pa.int32()))
        codes = self.first[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        begin = np.cumsum(sizes) - sizes
        parts, order = [], []
        for least, most in zip(WIDTHS, WIDTHS[1:], strict=False):
            own = np.flatnonzero((sizes > least) & (sizes <= most))
            if len(own):
                parts.append(self._merge(codes, begin[own], sizes[own], most))
                order.append(own)
        far = np.flatnonzero(sizes > WIDTHS[-1])
        if len(far):
            parts.append(pa.array([self.v.unit(words[i]) for i in far], pa.list_(pa.int32())))
            order.append(far)
        place = np.empty(len(words), dtype=np.int64)
        place[np.concatenate(order)] = np.arange(len(words))
        return pc.take(pa.concat_arrays(parts), pa.array(place))

    def _merge(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int) -> pa.ListArray:
        """Merges all words' best pairs (leftmost among equals), one pair a word at a time."""
        pairs, column = self.pairs, np.arange(width)
        inside = column < sizes[:, None]
        ids = np.full((len(sizes), width), -1, dtype=np.int32)
        ids[inside] = codes[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        out = np.full_like(ids, -1)
        ranks = np.full((len(sizes), width), NO_RANK, dtype=np.int32)
        both = np.flatnonzero(inside[:, 1:].ravel())
        both = both // (width - 1) * width + both % (width - 1)
        ranks.ravel()[both] = pairs.rank[pairs.find(ids.ravel()[both], ids.ravel()[both + 1])]
        row = np.arange(len(sizes))
        while len(row):
            best = ranks.argmin(1)
            on = np.arange(len(row))
            going = ranks[on, best] != NO_RANK
            if not going.all():
                out[row[~going]] = ids[~going]
                ids, ranks, row, best = ids[going], ranks[going], row[going], best[going]
                on = np.arange(len(row))
                if not len(row):
                    break
            piece = pairs.piece[pairs.find(ids[on, best], ids[on, best + 1])]
            past = column > best[:, None]
            ids[:, :-1] = np.where(past[:, :-1], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(past[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NO_RANK
            ids[on, best] = piece
            for side in (best - 1, best):
                ok = (side >= 0) & (side + 1 < width)
                ok[ok] = ids[on[ok], side[ok] + 1] >= 0
                now = np.full(len(row), NO_RANK, dtype=np.int32)
                now[ok] = pairs.rank[pairs.find(ids[on[ok], side[ok]], ids[on[ok], side[ok] + 1])]
                ranks[on[side >= 0], side[side >= 0]] = now[side >= 0]
        lengths, flat = (out >= 0).sum(1), out[out >= 0]
        bare = np.flatnonzero(flat >= len(self.v.pieces))  # characters without a piece become bytes
        if len(bare):
            emitted = [self.v.emit(int(x)) for x in flat[bare]]
            times = np.ones(len(flat), dtype=np.int64)
            times[bare] = list(map(len, emitted))
            word = np.repeat(np.arange(len(lengths)), lengths)
            lengths = np.bincount(word, weights=times, minlength=len(lengths)).astype(np.int64)
            at = np.cumsum(times) - times
            flat = np.repeat(flat, times)
            for i, e in zip(at[bare], emitted, strict=True):
                flat[i : i + len(e)] = e
        return _lists(lengths, flat)


def _lists(lengths: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


def _gathered(lists: pa.ListArray, number: pa.Array, group_sizes: np.ndarray) -> pa.ListArray:
    """The lists of those numbers, one after the other, joined in groups of so many."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)[number.to_numpy()]
    until = np.concatenate(([0], np.cumsum(lengths)))
    ends = until[np.concatenate(([0], np.cumsum(group_sizes)))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.take(lists, number).flatten())


def portions(rows: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of PORTION characters or ids, one row at least, so that what is worked out beside them stays small."""
    sizes = pc.fill_null(pc.binary_length(rows) if pa.types.is_string(rows.type) else pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // PORTION
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rows)]
    return (rows.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False))


def encode_batch(s: Segmenter, texts: pa.Array) -> pa.ListArray:
    """Ids of each text. Arrow cuts a batch at blanks and line feeds and numbers its different parts; their words are segmented once.

    A part is a whole number of words, as a piece has blanks at its beginning only. Texts in which
    blanks stand together or at the beginning, or that hold the marks used here, are taken one by one.
    """
    v, texts = s.v, texts.cast(pa.string()).fill_null("")
    odd = pc.match_substring_regex(texts, "^ |  |\x00|\u2581").to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", texts)
    marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x00▁"), "\n", "\x00\n\x00")
    parts = pc.split_pattern(pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise("▁", marked, "")), "\x00")
    number = parts.flatten().dictionary_encode()
    different = number.dictionary.to_numpy(zero_copy_only=False).tolist()
    # Line feeds are words of their own, so that they can stand between the parts.
    words = v.word.findall("\n".join("" if p == "\n" else p for p in different))
    code = pa.array(words, pa.string()).dictionary_encode()
    names = code.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "\n" not in names:
        names.append("\n")
    feed = names.index("\n")
    at = code.indices.to_numpy()
    own = at != feed
    per_part = np.bincount(np.cumsum(~own)[own], minlength=len(different))
    if "\n" in different:
        k = different.index("\n")
        per_part[k] = 1
        at = np.insert(at[own], per_part[:k].sum(), feed)
    else:
        at = at[own]
    by_part = _gathered(s.words(names), pa.array(at, pa.int32()), per_part)
    ids = _gathered(by_part, number.indices, pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    if not odd.any():
        return ids
    alone = pa.array([v.encode(t) for t in pc.filter(texts, pa.array(odd)).to_pylist()], pa.list_(pa.int32()))
    place = np.where(odd, len(texts) + np.cumsum(odd) - 1, np.arange(len(texts)))
    return pc.take(pa.concat_arrays([ids, alone]), pa.array(place))


def decode_batch(v: Vocabulary, raw: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Texts of lists of ids: the bytes of all pieces of a batch are laid out at once and cut where the lists end."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    laid = pc.take(raw, ids.flatten())
    offsets = np.frombuffer(laid.buffers()[1], dtype=np.int64, count=len(laid) + 1 + laid.offset)[laid.offset :]
    ends = offsets[np.concatenate(([0], np.cumsum(sizes)))]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), laid.buffers()[2]])
    try:
        text = pc.utf8_slice_codeunits(whole.cast(pa.large_string()), 1).cast(pa.string())  # the blank before each text
    except pa.ArrowInvalid:  # ids that no text has
        text = pa.array([b.decode("utf-8", "replace")[1:] for b in whole.to_pylist()], pa.string())
    return text if not ids.null_count else pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))


def cuts(v: Vocabulary, text: str, a: int, z: int) -> list[int]:
    """Places in (a, z) that no piece crosses, whatever stands before a."""
    return [m.start() for m in v.word.finditer(text, a, z) if m.start() > a]


def chunk_matrix(v: Vocabulary, text: str, a: int, z: int, first: bool) -> list:
    """Transfer matrix of text[a:z], whose margins show the pieces over its cuts: rows (entry, exit, weight)."""
    entries = [None] if first else v.states(text, a)
    inner = cuts(v, text, a, z)
    if not inner:
        return [(entries[k], e, w) for (k, e), w in v.transfer(text, entries, a, z).items()]
    into = {}
    for (piece, _), reached in v._walk(text, entries, a, inner[0]).get(inner[0], {}).items():
        for k, (w, _) in reached.items():
            into[k] = max(w, into.get(k, NEVER))
    middle = 0.0 if v.bpe else sum(v.scores[i] for u in v.word.findall(text, inner[0], inner[-1]) for i in v.unit(u))
    out_of = v.transfer(text, [None], inner[-1], z)
    return [(entries[k], e, w + middle + x) for k, w in into.items() for (_, e), x in out_of.items()]


def chunk_ids(v: Vocabulary, text: str, a: int, z: int, entry, leave) -> list[int]:
    """Ids of the pieces that begin in text[a:z], between known states."""
    inner = cuts(v, text, a, z)
    if not inner:
        return [x for p in v.trace(text, entry, a, z, leave) for x in v.emit(p)]
    out = [x for p in v.trace(text, entry, a, inner[0], None) for x in v.emit(p)]
    for u in v.word.findall(text, inner[0], inner[-1]):
        out += v.unit(u)
    return out + [x for p in v.trace(text, None, inner[-1], z, leave) for x in v.emit(p)]


def _key(state):
    return tuple(state) if state is not None else None


def combine(left: list, right: list) -> list:
    """Max-plus product of two transfer matrices."""
    by: dict = {}
    for i, j, w in right:
        by.setdefault(_key(i), []).append((_key(j), w))
    best: dict = {}
    for i, j, w in left:
        for k, x in by.get(_key(j), ()):
            if w + x > best.get((_key(i), k), NEVER):
                best[_key(i), k] = w + x
    return [(i, k, w) for (i, k), w in best.items()]


def cut_states(matrices: list[list], entry, leave) -> list:
    """States at all cuts of a row of matrices, both ends included, on the best path; ``leave`` None: the best last state."""
    value, steps = {_key(entry): 0.0}, []
    for m in matrices:
        now: dict = {}
        for i, j, w in m:
            if (v := value.get(_key(i))) is not None and v + w > now.get(_key(j), (NEVER,))[0]:
                now[_key(j)] = (v + w, _key(i))
        steps.append(now)
        value = {j: w for j, (w, _) in now.items()}
    state = _key(leave) if leave is not None else max(value, key=value.get)
    out = [state]
    for now in reversed(steps):
        state = now[state][1]
        out.append(state)
    return out[::-1]


def _long_texts(long: DataFrame, shared, chunk: int) -> DataFrame:
    """(key, ids) of long texts, from rows (key, text): the scan."""

    def split(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = normalise(text)
                margin, n = shared.value.longest, len(t)
                count = -(-n // chunk)
                for c in range(count):
                    a, z = c * chunk, min(n, (c + 1) * chunk)
                    lo = max(0, a - margin)
                    piece = t[lo : z + margin].replace(OWN_BLANK, "").encode("utf-8", "replace").decode()
                    own = [i for i in range(lo, min(n, z + margin)) if t[i] == OWN_BLANK]
                    yield pa.RecordBatch.from_pylist([{"key": key, "chunk": c, "a": a - lo, "z": z - lo, "text": t[lo : z + margin].replace(OWN_BLANK, " "), "own": [i - lo for i in own]}], schema=chunk_schema)

    chunk_schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("a", pa.int32()), ("z", pa.int32()), ("text", pa.string()), ("own", pa.list_(pa.int32()))])
    ddl = "key string, chunk long, a int, z int, text string, own array<int>"
    chunks = materialise(long.mapInArrow(split, ddl).repartition("key", "chunk").dropDuplicates(["key", "chunk"]), "chunks")

    def restored(text: str, own: list[int]) -> str:
        for i in own:
            text = f"{text[:i]}{OWN_BLANK}{text[i + 1:]}"
        return text

    @F.arrow_udf("string")
    def matrix(number: pa.Array, a: pa.Array, z: pa.Array, text: pa.Array, own: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (number, a, z, text, own)), strict=True)
        return pa.array([json.dumps(chunk_matrix(shared.value, restored(t, o), i, j, c == 0)) for c, i, j, t, o in rows], pa.string())

    block = (F.col("chunk") / BLOCK).cast("long").alias("block")
    matrices = materialise(chunks.select("key", block, "chunk", matrix("chunk", "a", "z", "text", "own").alias("m")), "matrices")

    def product(key, frame):
        import pandas as pd

        total = None
        for m in frame.sort_values("chunk")["m"]:
            total = json.loads(m) if total is None else combine(total, json.loads(m))
        return pd.DataFrame([(key[0], key[1], json.dumps(total))])

    blocks = matrices.groupBy("key", "block").applyInPandas(product, "key string, block long, m string")

    def between(key, frame):
        import pandas as pd

        frame = frame.sort_values("block")
        s = cut_states([json.loads(m) for m in frame["m"]], None, None)
        return pd.DataFrame([(key[0], b, json.dumps(i), json.dumps(j)) for b, i, j in zip(frame["block"], s, s[1:], strict=False)])

    ends = materialise(blocks.groupBy("key").applyInPandas(between, "key string, block long, i string, j string"), "blocks")

    def inside(key, frame):
        import pandas as pd

        frame = frame.sort_values("chunk")
        s = cut_states([json.loads(m) for m in frame["m"]], json.loads(frame["i"].iloc[0]), json.loads(frame["j"].iloc[0]))
        return pd.DataFrame([(key[0], c, json.dumps(i), json.dumps(j)) for c, i, j in zip(frame["chunk"], s, s[1:], strict=False)])

    found = matrices.join(ends, ["key", "block"]).groupBy("key", "block").applyInPandas(inside, "key string, chunk long, i string, j string")
    states = materialise(found, "states")  # so that no task finds states in one Python process and traces in another

    @F.arrow_udf("array<int>")
    def traced(a: pa.Array, z: pa.Array, text: pa.Array, own: pa.Array, i: pa.Array, j: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (a, z, text, own, i, j)), strict=True)
        return pa.array([chunk_ids(shared.value, restored(t, o), p, q, _key(json.loads(i)), _key(json.loads(j))) for p, q, t, o, i, j in rows], pa.list_(pa.int32()))

    parts = chunks.join(states, ["key", "chunk"]).select("key", "chunk", traced("a", "z", "text", "own", "i", "j").alias("ids"))
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("p"))
    return whole.select("key", F.flatten("p.ids").alias("ids"))


def encode(documents: DataFrame, vocabulary: Vocabulary | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids): one row per document."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())  # a tokenizer's pieces

    @F.arrow_udf("array<int>")
    def short(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([encode_batch(shared.value.segmenter, part) for part in portions(texts)])
            pa.default_memory_pool().release_unused()

    near, keyed, far = _by_length(documents, shared, chunk)
    return near.select("doc_id", short("text").alias("ids")).unionAll(keyed.join(far, "key").select("doc_id", "ids"))


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """All rows and columns and the text that their ids stand for."""
    return _decoded(encoded, encoded.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load()))


def round_trip(documents: DataFrame, vocabulary: Vocabulary | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, text): what decode() gives of encode().

    A column of ids that goes from one Python function to another takes two Python processes for each
    task, each with its vocabulary. Here the ids of a portion are decoded where they were made.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    @F.arrow_udf("struct<ids: array<int>, text: string>")
    def short(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = pa.array(shared.value.raw, pa.large_binary())
        for texts in batches:
            ids = [encode_batch(shared.value.segmenter, part) for part in portions(texts)]
            back = [decode_batch(shared.value, raw, part) for part in ids]
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(back)], ["ids", "text"])
            del ids, back
            pa.default_memory_pool().release_unused()

    near, keyed, far = _by_length(documents, shared, chunk)
    both = near.select("doc_id", short("text").alias("both")).select("doc_id", "both.ids", "both.text")
    return both.unionAll(_decoded(keyed.join(far, "key").select("doc_id", "ids"), shared))


def _by_length(documents: DataFrame, shared, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text) of texts of up to ``chunk`` characters, (doc_id, key) of the others, and (key, ids) of these."""
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    rows = documents.select("doc_id", "text")
    keyed = rows.where(is_long).select("doc_id", "text", F.sha2("text", 256).alias("key"))
    return rows.where(~is_long), keyed.select("doc_id", "key"), _long_texts(keyed.select("key", "text"), shared, chunk)


def _decoded(encoded: DataFrame, shared) -> DataFrame:
    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = pa.array(shared.value.raw, pa.large_binary())
        for ids in batches:
            yield pa.concat_arrays([decode_batch(shared.value, raw, part) for part in portions(ids)])
            pa.default_memory_pool().release_unused()

    return encoded.withColumn("text", text("ids"))
