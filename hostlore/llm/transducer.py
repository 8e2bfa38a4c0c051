"""Tokenizers compiled to finite-state machines, run over whole batches of text with numpy.

Two deterministic machines follow one another.

* The *splitter* reads character classes and marks where pieces begin. It has a dozen states, so a chunk of text is
  summed up by its state map (the state it leads to from each state). The maps of all chunks compose by a parallel
  prefix scan, after which every chunk knows the state it starts in and is read once more, all chunks in step.
* The *merger* reads the bytes of a piece. Each transition carries the change in the number of tokens of the piece
  so far, and each state knows the last token. What comes after a prefix depends only on its *live starts*: the
  places from which a token may still be open, with the token before each. These are the states, made when first
  met. Pieces longer than ``CHUNK`` are read in chunks: a chunk's map takes the states it may be entered in to the
  state it is left in and the tokens counted between, and the maps compose by the same prefix scan. As the states are not
  all known beforehand, a map begins with the start state and gets the states that the chunk before turns out to leave
  behind, until the scan finds every entry; a chunk that forgets how it was entered needs two.

That is exact for byte-pair encoding: leaving off the last token of an encoding leaves the encoding of the rest, and
a row of tokens is an encoding if each adjacent pair is (no merge crosses a boundary before both sides are done).

The classes of characters from U+0250 on are asked of the vocabulary's own pattern, a block of 256 when first met, and where
the vocabulary has a normaliser, texts with such characters pass it first. Only texts with strings of special tokens go
to the ``tokenizers`` library as a whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

LIMIT = 0x250
#: Surrogates, which no text has: one follows each text and resets the splitter.
RESET, PAD = 0xD800, 0xD801
TOP = 0x110000
UNKNOWN = 255
KINDS = ("L", "N", "S", "W", "O", "Q", "s", "r", "v", "l", "e", "R", "P")
BLANK = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
LANES = 2048
CHUNK = 256
#: At about 0.6 KB a state with a hundred classes of bytes.
MAX_STATES = 200_000
#: Texts are read in batches of so many characters, longer ones in parts of about this size.
BATCH_CHARS = 1 << 20
CUT = re.compile(r"(?<=\S)[ \n]")


def parts(text: str, size: int) -> Iterator[str]:
    """A long text in parts. No piece goes over a place where a blank follows a character that isn't one."""
    at = 0
    while len(text) - at > size and (found := CUT.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def in_batches(texts: Iterable[str], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of the texts, parts) with about ``size`` characters each."""
    numbers, held, chars = [], [], 0
    for i, text in enumerate(texts):
        for part in parts(text, size):
            numbers.append(i)
            held.append(part)
            chars += len(part)
            if chars >= size:
                yield numbers, held
                numbers, held, chars = [], [], 0
    if held:
        yield numbers, held


def kind_of(cp: int) -> str:
    c = chr(cp)
    if cp in BLANK:
        return "S" if cp == 32 else "W"
    if c == "'":
        return "Q"
    if c in "stmd":
        return "s"
    if c in "rvle":
        return c
    cat = unicodedata.category(c)[0]
    return cat if cat in "LN" else "O"


def known_kinds() -> np.ndarray:
    """A table over all code points, filled up to LIMIT and for RESET and PAD."""
    out = np.full(TOP, UNKNOWN, np.uint8)
    out[:LIMIT] = [KINDS.index(kind_of(cp)) for cp in range(LIMIT)]
    out[[RESET, PAD]] = KINDS.index("R"), KINDS.index("P")
    return out


#: States of the splitter: nothing open, letters, digits, others, one blank, several blanks (last a space or not), an
#: apostrophe that opened a piece, the same with r, v or l after it, a finished contraction.
STATES = ("0", "L", "N", "O", "S1", "S2", "W1", "W2", "Q", "Qr", "Qv", "Ql", "C")
LATE, NOW = 1, 2


def splitter(words: bool) -> tuple[np.ndarray, np.ndarray]:
    """next[state, kind] and marks[state, kind]: NOW, a piece begins here; LATE, one begins at the character before.

    ``words``: blanks are in no piece and every digit is one; else a single space joins the piece that follows and
    other blanks are pieces (all but the last of a run, when something follows).
    """
    nxt, mark = np.zeros((len(STATES), len(KINDS)), np.uint8), np.zeros((len(STATES), len(KINDS)), np.uint8)
    contraction = {("Q", "s"): "C", ("Q", "r"): "Qr", ("Q", "v"): "Qv", ("Q", "l"): "Ql", ("Qr", "e"): "C", ("Qv", "e"): "C", ("Ql", "l"): "C"}
    for i, state in enumerate(STATES):
        for k, kind in enumerate(KINDS):
            blanks = state in ("S1", "S2", "W1", "W2")
            base = {"L": "L", "s": "L", "r": "L", "v": "L", "l": "L", "e": "L", "N": "N", "O": "O", "Q": "O"}.get(kind)
            m = 0
            if kind == "P":
                to = state
            elif kind == "R":
                to, m = "0", NOW | (LATE if state in ("Qr", "Qv", "Ql") else 0)
            elif (state, kind) in contraction:
                to = contraction[state, kind]
            elif state in ("Qr", "Qv", "Ql"):  # the letter before begins a piece of letters after all
                m = LATE
                if base == "L":
                    to = "L"
                else:
                    m |= NOW
                    to = "Q" if kind == "Q" else base or ("S1" if kind == "S" else "W1")
            elif base is None:
                if words:
                    to, m = "S1", NOW
                elif blanks:
                    to = "S2" if kind == "S" else "W2"
                else:
                    to, m = ("S1" if kind == "S" else "W1"), NOW
            elif blanks and not words:
                to = base
                if state in ("S2", "W2"):
                    m |= LATE
                if state in ("W1", "W2"):
                    m |= NOW
                    to = "Q" if kind == "Q" else base
            elif state == base and not (words and base == "N") or state == "Q" and base == "O":
                to = base
            else:
                to, m = ("Q" if kind == "Q" else base), NOW
            nxt[i, k], mark[i, k] = STATES.index(to), m
    return nxt, mark


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps, one per row, in log2(rows) rounds."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def run_splitter(kinds: np.ndarray, nxt: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The state before every character."""
    n = kinds.size
    lanes = max(1, min(lanes, n // 64))
    width = -(-n // lanes)
    grid = np.full(lanes * width, KINDS.index("P"), np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    n_states, flat = len(nxt), nxt.ravel()
    maps = np.tile(np.arange(n_states, dtype=np.uint8), (lanes, 1))
    for row in grid:
        maps = flat[maps.astype(np.int64) * len(KINDS) + row[:, None]]
    state = np.concatenate([[0], scan(maps)[:-1, 0]]).astype(np.uint8)
    out = np.empty((width, lanes), np.uint8)
    for i, row in enumerate(grid):
        out[i] = state
        state = flat[state.astype(np.int64) * len(KINDS) + row]
    return np.ascontiguousarray(out.T).ravel()[:n]


#: A live start: node of the trie, token before it, tokens up to there less those of the whole prefix.
LIVE = struct.Struct("<iii")


class Merger:
    """The byte machine of a byte-pair vocabulary. Symbols are bytes, or 256 + byte for the last of a word."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str | None):
        to_byte = {c: b for b, c in byte_chars().items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        spelled: dict[int, tuple[int, ...]] = {}
        self.symbols: dict[int, int] = {}
        for c, b in to_byte.items():
            for text, symbol in ((c, b), *(((c + word_end, b + 256),) if word_end else ())):
                if text in vocab:
                    self.symbols[symbol] = vocab[text]
                    spelled[vocab[text]] = (symbol,)
        for rank, (a, b) in enumerate(m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(x << 20 | y, rank)
            if z not in self.parts and z not in spelled:
                self.parts[z] = (rank, x, y)
                spelled[z] = spelled[x] + spelled[y]
        #: The trie of tokens that are the encoding of their own spelling.
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.length = np.zeros(max(spelled) + 1, np.int64)
        for token, spelling in spelled.items():
            self.length[token] = len(spelling)
            if token in self.parts and not self.joined(*self.parts[token][1:]):
                continue
            node = 0
            for s in spelling:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][s]
            self.token[node] = token
        self.classes = np.full(512, -1, np.int64)
        self.n_classes = 0
        self.clear()

    def clear(self) -> None:
        """Forgets all states and what was found out about pairs of tokens."""
        start = LIVE.pack(0, -1, 0)
        self.pairs: dict[int, bool] = {}
        self.states: dict[bytes, int] = {start: 0}
        self.keys: list[bytes] = [start]
        self.last = np.full(1024, -1, np.int64)
        self.table = np.full((1024, max(32, self.n_classes)), -1, np.int32)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one side of a token while it forms, each with the rank that replaces it."""
        out = [(token, 1 << 60)]
        while (p := self.parts.get(out[-1][0])) is not None:
            out.append((p[side], p[0]))
        return out[::-1]

    def crosses(self, a: int, b: int) -> int:
        """The rank of the first merge over the boundary of tokens a and b, or -1."""
        left, right, i, j = self.edge(a, 2), self.edge(b, 1), 0, 0
        while True:
            (x, rx), (y, ry) = left[i], right[j]
            rank = self.rank.get(x << 20 | y, 1 << 59)
            if rank < rx and rank <= ry:
                return rank if rank < 1 << 59 else -1
            if rx == ry == 1 << 60:
                return -1
            if rx <= ry:
                i += 1
            else:
                j += 1

    def joined(self, a: int, b: int) -> bool:
        """Whether the encoding of a and b together is their merge: nothing crosses before both are whole."""
        return self.crosses(a, b) == self.rank[a << 20 | b]

    def stays(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self.crosses(a, b) < 0
        return known

    def step(self, state: int, symbol: int) -> tuple[bytes, int, int]:
        """The next state's key, the change of the count, the last token."""
        live, found = [], None
        for node, before, count in LIVE.iter_unpack(self.keys[state]):
            if (to := self.child[node].get(symbol)) is None:
                continue
            token = self.token[to]
            if found is None and token >= 0 and (before < 0 or self.stays(before, token)):
                found = token, count + 1
            if self.child[to]:
                live.append((to, before, count))
        if found is None:
            raise ValueError(f"no token for byte {symbol}")
        token, change = found
        return b"".join([*(LIVE.pack(n, b, c - change) for n, b, c in live), LIVE.pack(0, token, 0)]), change, token

    def grow(self, states: np.ndarray, symbols: np.ndarray) -> None:
        """Makes the transitions of distinct (state, symbol) pairs."""
        for symbol in np.unique(symbols).tolist():
            if self.classes[symbol] < 0:
                self.classes[symbol] = self.n_classes
                self.n_classes += 1
        if (more := self.n_classes - self.table.shape[1]) > 0:
            self.table = np.hstack([self.table, np.full((len(self.table), -(-more // 32) * 32), -1, np.int32)])
        for state, symbol in zip(states.tolist(), symbols.tolist(), strict=True):
            key, change, token = self.step(state, symbol)
            to = self.states.setdefault(key, len(self.keys))
            if to == len(self.keys):
                self.keys.append(key)
                if to == len(self.table):
                    more_rows = min(len(self.table), 1 << 15)
                    self.table = np.vstack([self.table, np.full((more_rows, self.table.shape[1]), -1, np.int32)])
                    self.last = np.concatenate([self.last, np.full(more_rows, -1, np.int64)])
                self.last[to] = token
            self.table[state, self.classes[symbol]] = to << 8 | (change + 128)

    def lockstep(
        self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entered: np.ndarray, tokens: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The state in which each chunk is left and the tokens counted in it; ``tokens`` gets the last one at every symbol."""
        order = np.argsort(-lengths, kind="stable")
        start, size = starts[order], lengths[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if size.size else 0) + 1), "right")
        state, count = entered[order].astype(np.int64), np.zeros(size.size, np.int64)
        for j, n in enumerate(active.tolist()):
            at = start[:n] + j
            now, s = state[:n], symbols[at]
            go = self.table[now, self.classes[s]]
            if (miss := np.flatnonzero((go < 0) | (self.classes[s] < 0))).size:
                pair = np.unique(now[miss] << 9 | s[miss])
                self.grow(pair >> 9, pair & 511)
                go[miss] = self.table[now[miss], self.classes[s[miss]]]
            state[:n] = go >> 8
            count[:n] += (go & 255) - 128
            if tokens is not None:
                tokens[at] = self.last[state[:n]]
        out, left = np.empty_like(count), np.empty_like(state)
        out[order], left[order] = count, state
        return left, out

    def composed(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state each chunk is entered in and its tokens. ``first``: whether a chunk begins a piece.

        Row r of ``enter``, ``leave`` and ``count`` is one entry of every chunk's map.
        """
        n = starts.size
        enter = np.zeros((1, n), np.int64)
        leave, count = (x[None] for x in self.lockstep(symbols, starts, lengths, enter[0]))
        while True:
            rows = len(enter)
            # from the entry of a chunk to the entry of the next one; the last column stands for one not in its map yet
            maps = np.full((n, rows + 1), rows, np.int64)
            same = enter[None, :, 1:] == leave[:, None, :-1]
            maps[:-1, :rows] = np.where(same.any(axis=1), same.argmax(axis=1), rows).T
            maps[:-1][first[1:]] = 0
            entry = np.concatenate([[0], scan(maps)[:-1, 0]])
            if (entry < rows).all():
                return enter[entry, np.arange(n)], count[entry, np.arange(n)]
            guess = np.where(entry < rows, entry, rows - 1)
            fresh = np.where(first, 0, np.roll(leave[guess, np.arange(n)], 1))
            to, more = leave[0].copy(), count[0].copy()
            todo = np.flatnonzero((enter != fresh).all(axis=0))
            to[todo], more[todo] = self.lockstep(symbols, starts[todo], lengths[todo], fresh[todo])
            fresh = np.where((enter != fresh).all(axis=0), fresh, 0)
            enter, leave, count = np.vstack([enter, fresh]), np.vstack([leave, to]), np.vstack([count, more])

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each piece; with ``keep`` the last token after every symbol."""
        if len(self.keys) > MAX_STATES:
            self.clear()
        tokens = np.empty(symbols.size, np.int32) if keep else None
        long = np.flatnonzero(lengths > CHUNK)
        out = np.zeros(lengths.size, np.int64)
        short = np.flatnonzero(lengths <= CHUNK)
        out[short] = self.lockstep(symbols, starts[short], lengths[short], np.zeros(short.size, np.int64), tokens)[1]
        if long.size:
            chunks = -(-lengths[long] // CHUNK)
            piece = np.repeat(np.arange(long.size), chunks)
            number = np.arange(piece.size) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            start = starts[long][piece] + number * CHUNK
            size = np.minimum(CHUNK, lengths[long][piece] - number * CHUNK)
            enter, count = self.composed(symbols, start, size, number == 0)
            out[long] = np.bincount(piece, count, long.size).astype(np.int64)
            if keep:
                self.lockstep(symbols, start, size, enter, tokens)
        return out, tokens


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


class Compiled:
    """A compiled vocabulary file; ``pieces`` cuts a batch of texts, ``counts`` and ``ids`` tokenise it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        end = spec["model"].get("end_of_word_suffix")
        self.words = bool(end)
        self.nxt, self.mark = splitter(self.words)
        self.merger = Merger(spec["model"]["vocab"], spec["model"]["merges"], end)
        self.kind = known_kinds()
        self.asked = np.arange(TOP >> 8) < LIMIT >> 8
        self.lower = np.arange(TOP, dtype=np.int32)
        if self.words:
            lower = [chr(c).lower() for c in range(LIMIT)]
            self.lower[:LIMIT] = [ord(x) if len(x) == 1 and ord(x) < LIMIT else -1 for x in lower]
        self.odd = {chr(c) for c in range(LIMIT) if self.lower[c] < 0}

    def special_in(self, text: str) -> bool:
        return "<|" in text and any(s in text for s in self.special)

    def normal(self, text: str) -> str:
        """What the splitter reads: the vocabulary's normaliser is asked where lower case alone would not do."""
        if not self.words or text.isascii() or max(text) < chr(LIMIT) and not self.odd.intersection(text):
            return text
        return self.library.normalizer.normalize_str(text)

    def ask(self, block: int) -> None:
        """The kinds of 256 characters, from where the vocabulary's pattern cuts each in a row of two."""
        for cp in range(block << 8, block + 1 << 8):
            if self.kind[cp] == UNKNOWN and not 0xD800 <= cp < 0xE000:
                cuts = [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(cp)}{chr(cp)}1")]
                if cuts[0] == (0, 3):
                    kind = "L"
                elif cuts[1] == (1, 3):
                    kind = "O"
                elif self.words:
                    kind = "W" if len(cuts) == 2 else "N"
                else:
                    kind = "N" if cuts[1] == (1, 4) else "W"
                self.kind[cp] = KINDS.index(kind)
        self.asked[block] = True

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, then start, length and text number of each piece."""
        joined = np.frombuffer(chr(RESET).join([*map(self.normal, texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        joined = self.lower[joined]
        kinds = self.kind[joined]
        if (unknown := kinds == UNKNOWN).any():
            for block in np.unique(joined[unknown] >> 8).tolist():
                self.ask(block)
            kinds = self.kind[joined]
        mark = self.mark[run_splitter(kinds, self.nxt), kinds]
        begins = (mark & NOW) > 0
        begins[:-1] |= (mark[1:] & LATE) > 0
        reset = joined == RESET
        width = np.where(joined < 0x80, 1, np.where(joined < 0x800, 2, np.where(joined < 0x10000, 3, 4)))
        width[reset] = 0
        at = np.cumsum(width) - width
        symbols = np.empty(int(width.sum()), np.int64)
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own = np.flatnonzero(width == n)
            if own.size:
                cp, to = joined[own], at[own]
                symbols[to] = lead | cp >> 6 * (n - 1)
                for k in range(1, n):
                    symbols[to + k] = 0x80 | cp >> 6 * (n - 1 - k) & 63
        first = np.flatnonzero(begins)
        drop = reset[first]
        if self.words:
            drop |= np.isin(kinds[first], (KINDS.index("S"), KINDS.index("W")))
        start = at[first]
        length = np.diff(np.concatenate([start, [symbols.size]]))
        doc = np.cumsum(reset)[first]
        start, length, doc = start[~drop], length[~drop], doc[~drop]
        if self.words and start.size:
            symbols[start + length - 1] += 256
        return symbols, start, length, doc

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for numbers, held in in_batches(texts, BATCH_CHARS):
            np.add.at(out, numbers, self.batch_counts(held))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, held in in_batches(texts, BATCH_CHARS):
            for i, ids in zip(numbers, self.batch_ids(held), strict=True):
                out[i].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def batch_counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain = [i for i, t in enumerate(texts) if t and not self.special_in(t)]
        if plain:
            symbols, start, length, doc = self.pieces([texts[i] for i in plain])
            count, _ = self.merger.run(symbols, start, length, False)
            out[plain] = np.bincount(doc, count, len(plain)).astype(np.int64)
        for i in set(range(len(texts))).difference(plain):
            if texts[i]:
                out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return out

    def batch_ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and not self.special_in(t)]
        if plain:
            symbols, start, length, doc = self.pieces([texts[i] for i in plain])
            count, last = self.merger.run(symbols, start, length, True)
            ids = np.empty(int(count.sum()), np.uint32)
            put, at, left = np.cumsum(count) - 1, start + length - 1, count
            while put.size:  # the last token first, then the one before it
                token = last[at]
                ids[put] = token
                more = left > 1
                put, at, left = put[more] - 1, (at - self.merger.length[token])[more], left[more] - 1
            size = np.bincount(doc, count, len(plain)).astype(np.int64)
            for i, part in zip(plain, np.split(ids, np.cumsum(size)[:-1]), strict=True):
                out[i] = part
        for i in set(range(len(texts))).difference(plain):
            if texts[i]:
                out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


_loaded: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """The machine of a file, compiled once a process."""
    if path not in _loaded:
        _loaded[path] = Compiled(path)
    return _loaded[path]
