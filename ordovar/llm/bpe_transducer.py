"""A byte-level BPE vocabulary compiled, as it is used, into a deterministic transducer.

State of the machine: what later bytes of a pre-token can still depend on, namely the longest suffix that starts some token, and
for each place in it the last token of the encoding up to that place and its token count. A transition reads one byte and is
annotated with the change of the token count. The states are finite in number; they and their transitions are made the first time
that a text needs them and kept in one dense table, which is emptied before the next texts when it has passed `max_states`.

Texts run in chunks, side by side, one numpy step a byte. A chunk begins at the start of a pre-token, where every state has the
same successor; its state map is therefore constant, and the composition of the maps in a text is the prefix sum of their counts.
"""

from __future__ import annotations

import json
import marshal

import numpy as np
import regex

from ordovar.llm.common import held

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CHUNK_BYTES = 192
#: Pairs of tokens of which it is kept whether they can be neighbours.
KNOWN_SEAMS = 1 << 18


def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files of this kind."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lead positions and code points of valid UTF-8."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    b = np.concatenate([buf, np.zeros(3, np.uint8)])
    cp = b[lead].astype(np.int32)
    wide = np.flatnonzero(cp >= 0x80)
    if len(wide):
        at, w = lead[wide], cp[wide]
        c1, c2, c3 = (b[at + i].astype(np.int32) & 63 for i in (1, 2, 3))
        cp[wide] = np.where(w < 0xE0, (w & 31) << 6 | c1, np.where(w < 0xF0, (w & 15) << 12 | c1 << 6 | c2, (w & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    return lead, cp


class Transducer:
    """Counts and ids of a vocabulary file with byte-level pre-tokenization; special strings in a text are single tokens."""

    #: The suffixes that the file's pre-tokenizer splits off after an apostrophe.
    CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, path: str, max_states: int = 240_000):
        model = json.load(open(path, encoding="utf-8"))
        stand_in = byte_alphabet()
        as_bytes = lambda s: bytes(stand_in[c] for c in s)
        self.specials = [(t["content"].encode(), t["id"]) for t in model["added_tokens"] if t["special"]]
        names = {t["content"] for t in model["added_tokens"]}
        self.id_of = {as_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in names}
        self.bytes_of = {i: s for s, i in self.id_of.items()}
        self.length = np.zeros(max(self.bytes_of) + 1, np.int32)
        for i, s in self.bytes_of.items():
            self.length[i] = len(s)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = (self.id_of[a], self.id_of[b])
            self.rank[pair] = r
            self.parts.setdefault(self.id_of[a + b], (*pair, r))
        #: What more bytes can complete to a token.
        self.prefixes = {s[:k] for s in self.id_of for k in range(1, len(s))}
        self.longest = max(map(len, self.id_of))
        self.classes = char_classes()
        self.max_states = max_states
        self._sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self.lefts = {a for a, _ in self.rank}
        self._edges: dict[int, int] = {}
        self._signs: dict[tuple, int] = {}
        self._clear()

    # -- the machine

    def _clear(self) -> None:
        self.keys: list[bytes] = []  # marshalled, which takes a fifth of the room
        self.number: dict[bytes, int] = {}
        self._fits.clear()
        self.column = np.zeros(256, np.int16)
        self.columns = 1  # column 0: bytes that were not seen yet, never filled
        # 0: not compiled yet. The system gives pages of zeros when they are first written to, so the whole table can be asked for at once
        self.next = self.last = None
        self.next = np.zeros((self.max_states * 9 // 8, 96), np.int32)
        self.last = np.zeros(self.max_states * 9 // 8, np.int32)
        self._intern((b"", (-1,), (0,)))

    def _intern(self, key: tuple) -> int:
        short = marshal.dumps(key, 0)
        k = self.number.get(short)
        if k is None:
            k = self.number[short] = len(self.keys)
            self.keys.append(short)
            if k == len(self.next):
                more = max(1024, k // 8)
                self.next = np.concatenate([self.next, np.zeros((more, self.next.shape[1]), np.int32)])
                self.last = np.concatenate([self.last, np.zeros(more, np.int32)])
            self.last[k] = key[1][-1]
        return k

    def _side(self, token: int, which: int) -> list[tuple[int, int]]:
        """The nodes on the right (1) or left (0) edge of a token's merge tree, and the rank at which each is merged away."""
        key = (token, which)
        found = self._sides.get(key)
        if found is None:
            found, until = [], 1 << 30
            while True:
                found.append((token, until))
                if token not in self.parts:
                    break
                until = self.parts[token][2]
                token = self.parts[token][which]
            self._sides[key] = found
        return found

    def _edge(self, token: int) -> int:
        """One token of those whose right edges can take part in the same merges; what follows cannot tell them apart."""
        found = self._edges.get(token)
        if found is None:
            sign = tuple((x, self._made(x), until) for x, until in self._side(token, 1) if x in self.lefts)
            found = self._edges[token] = self._signs.setdefault(sign, token)
        return found

    def _made(self, token: int) -> int:
        return self.parts[token][2] if token in self.parts else -1

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens: no merge spans the seam while both its sides exist."""
        found = self._fits.get(a << 32 | b)
        if found is None:
            found = True
            for x, x_ends in self._side(a, 1):
                for y, y_ends in self._side(b, 0):
                    r = self.rank.get((x, y))
                    if r is None:
                        continue
                    now = max(r, self._made(x), self._made(y))
                    if now < x_ends and (now < y_ends or now == y_ends == r):
                        found = False
                        break
                if not found:
                    break
            if len(self._fits) >= KNOWN_SEAMS:
                self._fits.clear()
            self._fits[a << 32 | b] = found
        return found

    def step(self, key: tuple, byte: int) -> tuple[tuple, int]:
        """The successor and the change of the token count."""
        tail, lasts, counts = key
        tail += bytes((byte,))
        for k in range(len(tail)):
            t = self.id_of.get(tail[k:])
            if t is not None and (lasts[k] == -1 or self.fits(lasts[k], t)):
                break
        else:
            raise ValueError(f"no token of the vocabulary ends at {tail!r}")
        count = counts[k] + 1
        change = count - counts[-1]
        lasts += (t,)
        counts += (count,)
        open_at = [tail[k:] in self.prefixes for k in range(len(tail))]
        cut = open_at.index(True) if True in open_at else len(tail)
        # of places where no token can begin any more, nothing is kept
        lasts = (*((x if x < 0 else self._edge(x)) if o else -2 for x, o in zip(lasts[cut:-1], open_at[cut:], strict=True)), t)
        counts = (*(c - count if o else 0 for c, o in zip(counts[cut:-1], open_at[cut:], strict=True)), 0)
        return (tail[cut:], lasts, counts), change

    def _column(self, byte: int) -> int:
        if not self.column[byte]:
            self.column[byte] = self.columns
            self.columns += 1
            if self.columns > self.next.shape[1]:
                wider = np.zeros((len(self.next), self.next.shape[1] + 16), np.int32)
                wider[: len(self.keys), : self.next.shape[1]] = self.next[: len(self.keys)]
                self.next = wider
        return self.column[byte]

    def _fill(self, state: np.ndarray, byte: np.ndarray) -> None:
        """Compiles the transitions that a step lacks."""
        for pair in np.unique(state.astype(np.int64) << 8 | byte):
            s, b = int(pair >> 8), int(pair & 255)
            c = self._column(b)
            if not self.next[s, c]:
                key, change = self.step(marshal.loads(self.keys[s]), b)
                self.next[s, c] = self._intern(key) << 8 | (change + 128)

    # -- texts

    def pretokens(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Flags of the bytes at which a pre-token starts, and (place, end, id) of the special strings."""
        start = np.zeros(len(buf) + 1, bool)
        if not len(buf):
            return start[:0], []
        edge = np.zeros(len(buf) + 1, bool)  # begins of texts and of what follows a special string
        edge[offsets] = True
        found = []
        raw = buf.tobytes()
        for s, i in self.specials:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(s) <= offsets[row + 1]:
                    found.append((at, at + len(s), i))
                    edge[at] = edge[at + len(s)] = True
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        lead, cp = code_points(buf)
        kind = self.classes[cp]
        n = len(cp)
        begin = edge[lead]
        ends = np.ones(n, bool)  # last of its text
        ends[:-1] = begin[1:]
        before = np.empty(n, np.uint8)
        before[0], before[1:] = SPACE, kind[:-1]
        blank_before = np.zeros(n, bool)
        blank_before[1:] = cp[:-1] == 32
        same = before == kind
        out = begin | ~same
        out &= begin | ~(blank_before & (kind != SPACE))
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = SPACE, kind[1:]
        out |= (kind == SPACE) & ~ends & (after != SPACE)
        marks = np.flatnonzero((cp == 39) & (begin | (before == LETTER) | (before == NUMBER) | ((before == SPACE) & ~blank_before)))
        if len(marks):
            padded = np.concatenate([cp, np.full(3, -1, cp.dtype)])
            stop = np.concatenate([begin, np.ones(3, bool)])
            done = np.zeros(len(marks), bool)
            for s in self.CONTRACTIONS:
                hit = ~done
                for j, ch in enumerate(s, 1):
                    hit &= (padded[marks + j] == ord(ch)) & ~stop[marks + j]
                done |= hit
                for j in range(1, len(s) + 1):
                    out[marks[hit] + j] = False
                nxt = marks[hit] + len(s) + 1
                out[nxt[nxt < n]] |= kind[nxt[nxt < n]] != SPACE
                # white space after a contraction starts a pre-token by the rules above
        start[lead[out]] = True
        for a, b, _ in found:
            start[a:b] = False
            start[a] = True
            if b < len(buf):
                start[b] = True
        return start[:-1], found

    def run(self, buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token after each byte and the change of the token count at it."""
        n = len(buf)
        changes = np.zeros(n, np.int8)
        if not n:
            return np.zeros(0, np.int32), changes
        if len(self.keys) > self.max_states:
            self._clear()
        places = np.flatnonzero(start)
        cuts = places[np.unique(np.searchsorted(places, np.arange(0, n, CHUNK_BYTES)).clip(max=len(places) - 1))]
        cuts = np.unique(np.concatenate([[0], cuts]))
        size = np.diff(np.concatenate([cuts, [n]]))
        order = np.argsort(-size, kind="stable")
        cuts, size = cuts[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        state = np.zeros(len(cuts), np.int32)
        got_at = np.empty(n, np.int32)
        column = self.column[buf]
        width, flat = self.next.shape[1], self.next.ravel()
        for k, m in enumerate(live):
            at = cuts[:m] + k
            now = state[:m]
            now[start[at]] = 0
            got = flat.take(now * width + column[at])
            if not got.all():
                byte = buf[at]
                lacking, seen = got == 0, self.columns
                flat = None  # else it would hold a table that is replaced
                self._fill(now[lacking], byte[lacking])
                if self.columns != seen:
                    column = self.column[buf]
                width, flat = self.next.shape[1], self.next.ravel()
                got = flat.take(now * width + column[at])
            state[:m] = got >> 8
            got_at[at] = got
        np.subtract(got_at & 255, 128, out=changes, casting="unsafe")
        return self.last[got_at >> 8], changes

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        start, special = self.pretokens(buf, offsets)
        _, changes = self.run(buf, start)
        for a, b, _ in special:
            changes[a:b] = 0
            changes[a] = 1
        total = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first place in them (texts + 1 values)."""
        start, special = self.pretokens(buf, offsets)
        tokens, _ = self.run(buf, start)
        n = len(buf)
        begins = np.flatnonzero(start)
        out = np.full(n + 1, -1, np.int32)  # the id at the place where its token begins
        at = np.concatenate([begins[1:], [n]]) if len(begins) else begins
        low = begins
        while len(at):  # back from the ends of all pre-tokens, one token each time
            t = tokens[at - 1]
            at = at - self.length[t]
            out[at] = t
            more = at > low
            at, low = at[more], low[more]
        for a, b, i in special:
            out[a:b] = -1
            out[a] = i
        have = out[:n] >= 0
        total = np.concatenate([[0], np.cumsum(have, dtype=np.int64)])
        return out[:n][have], total[offsets]


def transducer(path: str) -> Transducer:
    """One per worker process, kept while tasks use the same file."""
    return held(("transducer", path), lambda: Transducer(path))
