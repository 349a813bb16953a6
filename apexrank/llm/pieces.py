"""The vocabulary of a SentencePiece model file, and encoding as a max-plus scan over its lattice of pieces.

A text's segmentations are paths through nodes (position, last piece). An edge has the weight of appending a piece: the
piece's score for a unigram model, and for a BPE model 0 if the two adjacent pieces stay as they are when their joint string is
merged alone, else minus infinity. For BPE just one path keeps a finite weight, and it is the model's own encoding: whatever
merge would first cross a boundary of the path would also be the best one in the joint string of the two pieces there. So the
path of the largest weight is the encoding for either kind, and weights of stretches combine associatively.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"
MINUS = float("-inf")
#: Fixed values of the model format: kinds of piece and of model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A letter, as a pattern.
LETTER = r"[^\W\d_]"
#: Words and pairs of pieces whose segmentation a worker remembers, words in each of two generations.
REMEMBERED = 150_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; length-delimited and fixed values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Vocabulary:
    """Pieces by id, and the rules of the model file that bear on encoding."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    dummy_prefix: bool
    ids: dict[str, int] = field(init=False)
    bytes_at: dict[int, int] = field(init=False)
    unknown: int = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.longest = max((len(p) for p in self.ids), default=1)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        whole = all(not re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids)
        self.word = re.compile(f"\n|{SPACE}*{LETTER}++{self._parting()}|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+") if whole else None
        self.four = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self.rank = {p: self.scores[i] for p, i in self.ids.items()}
        self.heads = {p[:n] for p in self.ids for n in range(1, len(p))}
        self.pairs: dict[str, dict[str, bool]] = {}  # whether a piece fits behind another
        self.paired = 0
        #: The bytes that each piece decodes to; byte pieces give their byte.
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes_at.items():
            self.raw[i] = bytes([b])
        for i, k in enumerate(self.kinds):
            if k in (CONTROL, UNKNOWN):
                self.raw[i] = b"" if k == CONTROL else b" \xe2\x81\x87 "
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _parting(self) -> str:
        """A pattern for the end of a run of letters where no piece can lie across: no piece has what stands before and behind next to
        each other."""
        before: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if re.fullmatch(LETTER, a):
                    before.setdefault(b, set()).add(a)
        listed = lambda chars: "".join(map(re.escape, sorted(chars)))
        marks = [b for b in sorted(before) if not re.fullmatch(LETTER, b)]
        cases = [f"(?=[^{SPACE}\n{listed(before)}])", *(f"(?<![{listed(before[b])}])(?={re.escape(b)})" for b in marks)]
        return f"(?:{'|'.join(cases)})"

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        pieces, scores, kinds, model, dummy = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                own = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own[2], "<f4")[0]))
                kinds.append(own[3])
            elif number == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                dummy = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models without a character map that keep all white space are supported")
        if model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if USER_DEFINED in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        return cls(pieces, scores, kinds, model, dummy)

    def normal(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix and text else text

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short strings: the best adjacent pair is merged, the leftmost of equals, until none is left."""
        parts, rank = list(text), self.rank
        gains = [rank.get(a + b, MINUS) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == MINUS:
                break
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = rank.get(parts[at - 1] + parts[at], MINUS)
            if at < len(gains):
                gains[at] = rank.get(parts[at] + parts[at + 1], MINUS)
        return parts

    def weight(self, last: str, piece: str) -> float:
        """Of appending piece to a path that ends with last (empty: at the text's start)."""
        if self.model == UNIGRAM:
            found = self.ids.get(piece)
            return self.scores[found] if found is not None else self.floor
        fits = self.pairs.get(last, {}).get(piece)
        if fits is None:
            if self.paired >= REMEMBERED:
                self.pairs.clear()
                self.paired = 0
            self.paired += 1
            fits = self.merged(last + piece) == ([last, piece] if last else [piece])
            self.pairs.setdefault(last, {})[piece] = fits
        return 0.0 if fits else MINUS

    def starts(self, text: str, at: int) -> list[str]:
        """The pieces that text has at a position; a single character is always one."""
        head = text[at]
        out, end = [head], at + 1
        while head in self.heads and end < len(text):
            end += 1
            head = text[at:end]
            if head in self.ids:
                out.append(head)
        return out

    def numbers(self, piece: str) -> list[int]:
        """Ids of a piece; a character that is none falls back to its bytes."""
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        if self.bytes_at:
            return [self.bytes_at[b] for b in piece.encode()]
        return [self.unknown]

    def packed(self, piece: str) -> bytes:
        found = self.ids.get(piece)
        return self.four[found] if found is not None else b"".join([self.four[i] for i in self.numbers(piece)])

    # The scan. A state at a cut is (last piece, its characters beyond the cut): the first node at or after the cut.

    def is_reset(self, text: str, cut: int) -> bool:
        """Whether no piece can lie across a cut inside text; all paths share the state ("", 0) there."""
        return self.word is not None and 0 < cut < len(text) and ((text[cut] == SPACE and text[cut - 1] != SPACE) or "\n" in text[cut - 1 : cut + 1])

    def states_at(self, text: str, cut: int) -> list[tuple[str, int]]:
        """Every state that some path can have at a cut inside text, from the characters around it alone."""
        if self.is_reset(text, cut):
            return [("", 0)]
        out = []
        for begin in range(max(0, cut - self.longest), cut):
            out += [(p, begin + len(p) - cut) for p in self.starts(text, begin) if begin + len(p) >= cut]
        return out

    def sweep(self, text: str, begin: int, end: int, states: list[tuple[str, int]]) -> dict[tuple[str, int], np.ndarray]:
        """For each state at end the vector of largest weights from each state at begin, over text[begin:end]."""
        nodes: dict[int, dict[str, np.ndarray]] = {}
        for k, (piece, over) in enumerate(states):
            row = nodes.setdefault(begin + over, {}).setdefault(piece, np.full(len(states), MINUS))
            row[k] = 0.0
        for at in range(begin, end):
            here = nodes.pop(at, None)
            if not here:
                continue
            for piece in self.starts(text, at):
                best = None
                for last, row in here.items():
                    w = self.weight(last, piece)
                    if w > MINUS:
                        best = row + w if best is None else np.maximum(best, row + w)
                if best is not None:
                    nodes.setdefault(at + len(piece), {})[piece] = best
        return {(piece, at - end): row for at, here in nodes.items() for piece, row in here.items()}

    def trace(self, text: str, begin: int, end: int, entry: tuple[str, int], leave: tuple[str, int] | None = None) -> list[str]:
        """The pieces after the entry state up to the leaving state (default: the best that ends at end), on the best path."""
        nodes: dict[int, dict[str, tuple[float, str]]] = {begin + entry[1]: {entry[0]: (0.0, "")}}
        for at in range(begin + entry[1], end):
            here = nodes.get(at)
            if not here:
                continue
            for piece in self.starts(text, at):
                best, source = MINUS, None
                for last, (have, _) in here.items():
                    w = have + self.weight(last, piece)
                    if w > best:
                        best, source = w, last
                if source is not None:
                    nodes.setdefault(at + len(piece), {})[piece] = (best, source)
        if leave is None or (leave == ("", 0) and begin < end):
            leave = (max(nodes[end], key=lambda p: nodes[end][p][0]), 0)
        out, at, piece = [], end + leave[1], leave[0]
        while at > begin + entry[1]:
            out.append(piece)
            at, piece = at - len(piece), nodes[at][piece][1]
        return out[::-1]

    def only_path(self, text: str) -> list[str]:
        """trace() from the start for BPE, where just one path to each position has a finite weight: longer pieces are tried first, and
        a position from which the end was not reached is not tried again."""
        n, pairs, heads, ids, dead = len(text), self.pairs, self.heads, self.ids, set()
        path, waiting = [], []
        at, before = 0, ""
        while True:
            choices, end = [text[at]], at + 1  # as starts()
            head = choices[0]
            while end < n and head in heads:
                end += 1
                head = text[at:end]
                if head in ids:
                    choices.append(head)
            while True:
                known = pairs.get(before)
                while choices:
                    piece = choices.pop()
                    end = at + len(piece)
                    if end in dead:
                        continue
                    fits = known.get(piece) if known else None
                    if fits or (fits is None and self.weight(before, piece) > MINUS):
                        break
                else:
                    dead.add(at)
                    at, before, choices = waiting.pop()
                    path.pop()
                    continue
                break
            path.append(piece)
            if end == n:
                return path
            waiting.append((at, before, choices))
            at, before = end, piece

    def word_ids(self, word: str) -> bytes:
        """Little-endian 32-bit ids of a stretch that no piece crosses the ends of."""
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = b"".join(map(self.packed, self.only_path(word) if self.model == BPE else self.trace(word, 0, len(word), ("", 0))))
            if len(word) <= 40:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[word] = found
        return found

    def encode(self, normal: str) -> bytes:
        """Ids of a normalised text, stretch by stretch where pieces can't lie across."""
        if self.word is None:
            return self.word_ids(normal) if normal else b""
        known = self.known.get
        return b"".join([known(w) or self.word_ids(w) for w in self.word.findall(normal)])

    def resets(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and last place in [begin, end] that no piece can lie across."""
        if self.word is None:
            return None
        safe = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)")
        first = safe.search(text, begin, min(len(text), end + 1))
        if not first or first.start() > end:
            return None
        last, step = first.start(), 256
        while True:  # from the end, in growing strides
            low = max(begin, end - step)
            spots = [m.start() for m in safe.finditer(text, low, min(len(text), end + 1)) if m.start() <= end]
            if spots or low == begin:
                return first.start(), max([last, *spots])
            step *= 4

    def transfer(self, text: str, begin: int, end: int, first: bool) -> list[tuple[tuple[str, int], tuple[str, int], float]]:
        """The finite entries of the max-plus matrix from the states at begin to those at end. Between two resets the weight
        is one number, so the matrix is a column times a row; a chunk without a reset is swept whole."""
        entry = [("", 0)] if first else self.states_at(text, begin)
        spots = self.resets(text, begin, end)
        out = []
        if spots and spots[0] < spots[1]:
            left: dict[int, float] = {}
            for row in (v for (_, over), v in self.sweep(text, begin, spots[0], entry).items() if over == 0):
                for k, w in enumerate(row):
                    left[k] = max(left.get(k, MINUS), float(w))
            middle = self.stretch_weight(text[spots[0] : spots[1]])
            right = self.sweep(text, spots[1], end, [("", 0)])
            for k, a in left.items():
                out += [(entry[k], s, a + middle + float(row[0])) for s, row in right.items() if a + float(row[0]) > MINUS]
        else:
            for s, row in self.sweep(text, begin, end, entry).items():
                out += [(entry[k], s, float(w)) for k, w in enumerate(row) if w > MINUS]
        if self.is_reset(text, end):
            best: dict = {}
            for e, _, w in out:
                best[e] = max(w, best.get(e, MINUS))
            out = [(e, ("", 0), w) for e, w in best.items()]
        return out

    def stretch_weight(self, text: str) -> float:
        if self.model == BPE:
            return 0.0
        total = 0.0
        for word in self.word.findall(text):
            last = ""
            for piece in self.trace(word, 0, len(word), ("", 0)):
                total, last = total + self.weight(last, piece), piece
        return total

    def text(self, raw: bytes) -> str:
        """The text of the joined bytes of pieces: the prefix's space is taken off."""
        out = raw.decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out

    def decode(self, ids) -> str:
        """The text of ids."""
        return self.text(b"".join(map(self.raw.__getitem__, ids)))


def compose(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices {(state, state): weight}; associative."""
    by: dict = {}
    for (s, t), w in b.items():
        by.setdefault(s, []).append((t, w))
    out: dict = {}
    for (r, s), v in a.items():
        for t, w in by.get(s, ()):
            if v + w > out.get((r, t), MINUS):
                out[r, t] = v + w
    return out
