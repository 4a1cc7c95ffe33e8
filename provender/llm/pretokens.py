"""Vectorised pre-tokenisation: class arrays and an associative scan of transition functions.

A text becomes an array of codepoint classes. Each class is a function on the states of a small automaton;
the functions that arise by composing them form a finite monoid, whose elements are numbered once. A scan
with the monoid's multiplication table, over blocks side by side, gives the state before each character
with two table look-ups a character and no regular expression. A token starts where the automaton says so.

Tokens are then looked up by content: a 64-bit hash of their codepoints finds an entry of a cache, and each is compared
with that entry's, so that Python sees tokens that aren't kept alone and no two are taken for one.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

# Classes of single characters; RESET stands between texts, ODD is what Unicode versions may class differently.
LETTER, NUMBER, OTHER, SPACE, WHITE, INNER, SHORT, LONG, RESET, ODD = range(10)
# States: nothing open, in letters, in numbers, in others, after a leading space, in white space, and with
# one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, LEAD, WHITES, ONE, TWO = range(8)
_STATES = 8

#: A text of the class ODD.
UNASSIGNED = "\u0378"
#: What follows an apostrophe in the contractions of the public patterns.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")


def _spaced(state: int, kind: int) -> tuple[int, bool]:
    """The byte-level pattern: a space belongs to the word after it. Gives the next state and whether a token starts."""
    if kind == LETTER:
        if state == TWO:
            return ONE, False
        if state == ONE:
            return FRESH, False
        return LETTERS, state not in (LETTERS, LEAD)
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, LEAD)
    if kind in (SHORT, LONG) and state not in (OTHERS, LEAD):
        return (ONE if kind == SHORT else TWO), True
    if kind in (OTHER, SHORT, LONG, ODD):
        return OTHERS, state not in (OTHERS, LEAD)
    if kind == INNER:
        return WHITES, state != WHITES
    return {SPACE: LEAD, WHITE: FRESH, RESET: FRESH}[kind], True


def _spaceless(state: int, kind: int) -> tuple[int, bool]:
    """The word-end pattern: white space separates and is dropped, each number stands alone."""
    if kind == NUMBER:
        return FRESH, True
    if kind in (SPACE, WHITE, INNER):
        return WHITES, state != WHITES
    return _spaced(state, kind)


GRAMMARS = {"spaced": _spaced, "spaceless": _spaceless}


@cache
def classes(next_line: int = ODD) -> np.ndarray:
    """The class of each codepoint, by its general category; next_line: that of U+0085, on which libraries differ."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(code))
        if category[0] == "L":
            table[code] = LETTER
        elif category[0] == "N":
            table[code] = NUMBER
        elif category == "Cn" or category == "Cs":
            table[code] = ODD
    for code in (9, 10, 11, 12, 13, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[code] = WHITE
    table[32] = SPACE
    for code in (*range(0x1C, 0x20), 0x180E):  # regex libraries differ on whether these are white space
        table[code] = ODD
    table[0x85] = next_line
    return table


@cache
def monoid(grammar: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """product[a, b] (a, then b) over numbered functions; apply[a, state]; starts[state, class]. Functions 0..9 are the classes'."""
    step = GRAMMARS[grammar]
    functions = [tuple(step(s, k)[0] for s in range(_STATES)) for k in range(10)]
    numbers: dict[tuple, int] = {}
    every: list[tuple] = list(functions)
    for i, f in enumerate(functions):
        numbers.setdefault(f, i)
    at = 0
    while at < len(every):
        for f in functions:
            made = tuple(f[s] for s in every[at])
            if made not in numbers:
                numbers[made] = len(every)
                every.append(made)
        at += 1
    n = len(every)
    product = np.zeros((n, n), np.uint16)
    for i, a in enumerate(every):
        for j, b in enumerate(every):
            product[i, j] = numbers[tuple(b[s] for s in a)]
    starts = np.array([[step(s, k)[1] for k in range(10)] for s in range(_STATES)])
    return product, np.array(every, np.uint8), starts


def states(kinds: np.ndarray, grammar: str) -> np.ndarray:
    """The automaton's state before each character, from FRESH: an exclusive scan in blocks side by side."""
    product, apply, _ = monoid(grammar)
    n = len(kinds)
    width = max(16, int(n**0.5))
    blocks = -(-n // width)
    grid = np.full(blocks * width, RESET, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)  # row j: character j of every block
    flat, m = product.ravel(), product.shape[1]
    # Pass 1: the function of each whole block.
    whole = grid[0].astype(np.intp)
    for j in range(1, width):
        whole = flat[whole * m + grid[j]].astype(np.intp)
    # The state at the head of each block: the blocks' functions, one after the other.
    head = np.empty(blocks, np.intp)
    state = FRESH
    for b, f in enumerate(whole.tolist()):
        head[b] = state
        state = int(apply[f, state])
    # Pass 2: within the blocks, from those heads.
    table = apply[:10].T.ravel()  # [state, class]
    out = np.empty((width, blocks), np.uint8)
    now = head
    for j in range(width):
        out[j] = now
        now = table[now * 10 + grid[j]].astype(np.intp)
    return np.ascontiguousarray(out.T).ravel()[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, the same wherever it stands. Spans are sorted and don't overlap.

    The hash is a sum of mixed (value, place in the span) pairs: no polynomial, whose values modulo 2^64
    coincide for regular sequences. Equal hashes are still no proof: see equal_spans().
    """
    length = ends - starts
    place = np.arange(len(values), dtype=np.int64)
    base = np.zeros(len(values), np.int64)
    if len(starts):
        base[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, len(values))))
    place -= base
    mixed = mix((values.astype(np.uint64) << np.uint64(36)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    return mix(sums[ends] - sums[starts] + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def equal_spans(values: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """For each i, whether values[a[i]:a[i] + length[i]] and others[b[i]:b[i] + length[i]] are the same; others: values, if not given."""
    others = values if others is None else others
    out = np.ones(len(a), bool)
    some = np.flatnonzero(length > 0)
    if not len(some):
        return out
    n = length[some]
    first = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(first, n)
    differ = values[np.repeat(a[some], n) + step] != others[np.repeat(b[some], n) + step]
    out[some] = ~np.logical_or.reduceat(differ, first)
    return out


class Pretokens:
    """The pre-tokens of some texts. token t is joined[start[t]:end[t]]; those of text k are first[k]:first[k + 1]."""

    def __init__(self, texts: list[str], grammar: str, next_line: int = ODD):
        self.joined = joined = "\n".join([*texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = classes(next_line)[code]
        ends = np.cumsum([len(t) + 1 for t in texts])
        kinds[ends - 1] = RESET
        after = np.append(kinds[1:], RESET)
        white = (kinds == SPACE) | (kinds == WHITE)
        kinds[white & ((after == SPACE) | (after == WHITE) | (after == RESET))] = INNER
        quotes = np.flatnonzero(code == 39)
        for i in quotes.tolist():
            if joined[i + 1 : i + 2] in ONE_LETTER and kinds[i + 1] == LETTER:
                kinds[i] = SHORT
            elif joined[i + 1 : i + 3] in TWO_LETTERS:
                kinds[i] = LONG
        self.odd = np.zeros(len(texts), bool)
        if len(strange := np.flatnonzero(kinds == ODD)):
            self.odd[np.searchsorted(ends, strange, side="right")] = True
        starts = monoid(grammar)[2].ravel()[states(kinds, grammar).astype(np.intp) * 10 + kinds]
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(code))
        # A leading space of the first kind is its own class; separators, and dropped white space, are no tokens.
        keep = kinds[start] != RESET
        if grammar == "spaceless":
            keep &= ~np.isin(kinds[start], (SPACE, WHITE, INNER))
        self.start, self.end = start[keep], end[keep]
        self.first = np.append(0, np.searchsorted(self.start, ends))
        self.code = code
        self.hashes = span_hashes(code, self.start, self.end)

    def texts(self, number: np.ndarray) -> list[str]:
        """The tokens of these numbers."""
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.start[number].tolist(), self.end[number].tolist(), strict=True)]


def ragged(pool: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[offsets[k]:offsets[k] + lengths[k]] for each k of number, joined; and where each begins (with the end, one more)."""
    n = lengths[number]
    at = np.append(0, np.cumsum(n))
    index = np.repeat(offsets[number] - at[:-1], n)
    index += np.arange(at[-1])
    return pool[index], at


#: Tokens in a cache: bounds a worker's memory.
KEPT = 500_000
#: Longer tokens are encoded but not kept.
LONG_PIECE = 48
_SLOT_BITS = 20


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size` values at least."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, len(array) * 3 // 2), array.dtype)
    out[: len(array)] = array
    return out


class Kept:
    """The ids of tokens, in arrays: an open hash table, and for each entry its codepoints, its ids and when it was last asked for.

    A look-up finds the entry of a hash and compares the codepoints. When it is full, the half that was asked for last stays.
    """

    def __init__(self, dtype: np.dtype, limit: int = KEPT):
        self.limit, self.tick = limit, 0
        self.code, self.ids = np.zeros(limit, np.uint32), np.zeros(limit, dtype)
        # Of each entry: hash, codepoints' place and number, ids' place and number, time.
        self.hash = np.zeros(limit, np.uint64)
        self.code_at, self.code_n, self.id_at, self.id_n = (np.zeros(limit, np.int64) for _ in range(4))
        self.last = np.zeros(limit, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.n = self.code_end = self.id_end = 0
        self.bits = max(_SLOT_BITS, (2 * self.limit - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        slot, left, mask = self._slot(hashes), np.arange(len(hashes)), (1 << self.bits) - 1
        while len(left):
            entry = self.slots[slot]
            there = entry >= 0
            if not there.all():
                left, slot, entry = left[there], slot[there], entry[there]
            hit = self.hash[entry] == hashes[left]
            out[left[hit]] = entry[hit]
            left, slot = left[~hit], slot[~hit] + 1 & mask
        return out

    def _add(self, hashes: np.ndarray, code: np.ndarray, code_n: np.ndarray, ids: np.ndarray, id_n: np.ndarray) -> None:
        """New entries of distinct new hashes, with their codepoints and ids one after the other."""
        new = np.arange(self.n, self.n + len(hashes))
        self.hash[new], self.code_n[new], self.id_n[new] = hashes, code_n, id_n
        self.code_at[new], self.id_at[new] = self.code_end + np.cumsum(code_n) - code_n, self.id_end + np.cumsum(id_n) - id_n
        self.code, self.ids = _grown(self.code, self.code_end + len(code)), _grown(self.ids, self.id_end + len(ids))
        self.code[self.code_end : self.code_end + len(code)], self.ids[self.id_end : self.id_end + len(ids)] = code, ids
        self.n, self.code_end, self.id_end = self.n + len(hashes), self.code_end + len(code), self.id_end + len(ids)
        slot, mask = self._slot(hashes), (1 << self.bits) - 1
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            out = self.slots[slot] != new
            new, slot = new[out], slot[out] + 1 & mask

    def _halve(self) -> None:
        keep = np.argsort(-self.last[: self.n], kind="stable")[: self.limit // 2]
        code, ids = (ragged(pool, at, n, keep)[0] for pool, at, n in ((self.code, self.code_at, self.code_n), (self.ids, self.id_at, self.id_n)))
        hashes, code_n, id_n, last = self.hash[keep], self.code_n[keep], self.id_n[keep], self.last[keep]
        self._clear()
        self._add(hashes, code, code_n, ids, id_n)
        self.last[: self.n] = last

    def get(self, cut: Pretokens, make) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, offsets, lengths, number: those of token t are ids[offsets[k]:offsets[k] + lengths[k]], k = number[t]; make(list) encodes tokens."""
        length, width, self.tick = cut.end - cut.start, self.ids.dtype.itemsize, self.tick + 1
        number = self.find(cut.hashes)
        unknown = np.flatnonzero((number < 0) & (length <= LONG_PIECE))
        first = unknown[np.unique(cut.hashes[unknown], return_index=True)[1]]
        if self.n + len(first) > self.limit:
            self.last[number[number >= 0]] = self.tick
            self._halve()
            number = self.find(cut.hashes)
            unknown = np.flatnonzero((number < 0) & (length <= LONG_PIECE))
            first = unknown[np.unique(cut.hashes[unknown], return_index=True)[1]][: self.limit - self.n]
        if len(first):
            values = make(cut.texts(first))
            code = ragged(cut.code, cut.start, length, first)[0]
            self._add(cut.hashes[first], code, length[first], np.frombuffer(b"".join(values), self.ids.dtype), np.array([len(v) // width for v in values]))
            number[unknown] = self.find(cut.hashes[unknown])
        self.last[number[number >= 0]] = self.tick
        # A token that isn't its entry's, is long or found no room is encoded by itself.
        same = (number >= 0) & (self.code_n[number] == length)
        some = np.flatnonzero(same)
        same[some] = equal_spans(cut.code, cut.start[some], self.code_at[number[some]], length[some], self.code)
        ids, offsets, lengths = self.ids[: self.id_end], self.id_at[: self.n], self.id_n[: self.n]
        if len(alone := np.flatnonzero(~same)):
            more: dict[str, int] = {}
            number[alone] = [self.n + more.setdefault(t, len(more)) for t in cut.texts(alone)]
            values = make(list(more))
            n = np.array([len(v) // width for v in values])
            ids = np.concatenate([ids, np.frombuffer(b"".join(values), ids.dtype)])
            offsets, lengths = np.append(offsets, self.id_end + np.cumsum(n) - n), np.append(lengths, n)
        return ids, offsets, lengths, number


class Encoder:
    """Encodes whole texts; a subclass gives the ids of single pre-tokens (make) and of odd texts (whole)."""

    grammar = "spaced"
    next_line = ODD
    dtype = np.dtype("<u4")

    #: The cache; made with the first texts, when dtype is known.
    kept: Kept | None = None

    def make(self, tokens: list[str]) -> list[bytes]:
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray | None:
        """The ids of a text with odd characters, if this encoder has another way for them."""
        return None

    def prepare(self, text: str) -> str:
        return text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = Pretokens([self.prepare(t) for t in texts], self.grammar, self.next_line)
        self.kept = self.kept or Kept(self.dtype)
        ids, at = ragged(*self.kept.get(cut, self.make))
        cuts = at[cut.first].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in np.flatnonzero(cut.odd).tolist():
            if (other := self.whole(texts[k])) is not None:
                out[k] = other
        return out


class LibraryEncoder(Encoder):
    """Ids as the tokenizers library gives them for whole texts, without special tokens."""

    def __init__(self, path: str, largest_id: int = 0):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        ends = any(t.endswith("</w>") for t in vocabulary)
        self.grammar = "spaceless" if ends else "spaced"
        top = max([largest_id, *vocabulary.values()])
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        #: Of each id, whether it is the first (spaced) or last (spaceless) one of a word that was joined with others.
        self.edge = np.zeros(top + 1, bool)
        for token, number in vocabulary.items():
            self.edge[number] = token.endswith("</w>") if ends else token.startswith("Ġ")

    def prepare(self, text: str) -> str:
        if self.grammar == "spaced" or text.isascii():
            return text.lower() if self.grammar == "spaceless" else text
        # What Python would lower or compose otherwise than the library is left to whole().
        return text.lower() if "Σ" not in text and unicodedata.is_normalized("NFC", text) else UNASSIGNED

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def make(self, tokens: list[str]) -> list[bytes]:
        """Words are encoded 32 at a time, which the library does in half the time; other tokens alone."""
        spaced = self.grammar == "spaced"
        out: list = [None] * len(tokens)
        words = [i for i, t in enumerate(tokens) if ((t[0] == " " and t[1:].isalpha()) if spaced else t.isalpha())]
        rest = np.ones(len(tokens), bool)
        rest[words] = False
        groups = [words[k : k + 32] for k in range(0, len(words), 32)]
        glue = "" if spaced else " "
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([glue.join([tokens[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            edges = np.flatnonzero(self.edge[ids])
            cuts = [*edges.tolist(), len(ids)] if spaced else [0, *(edges + 1).tolist()]
            if len(cuts) != len(group) + 1:
                rest[group] = True
                continue
            for i, a, b in zip(group, cuts, cuts[1:], strict=False):
                out[i] = ids[a:b].tobytes()
        alone = np.flatnonzero(rest).tolist()
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([tokens[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out


class RankEncoder(Encoder):
    """Byte-level BPE by a rank file: each pre-token is a known one, or its bytes are merged pair by pair, lowest rank first."""

    next_line = WHITE

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.dtype = np.dtype("<u2" if max(self.ranks.values()) < 1 << 16 else "<u4")
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def make(self, tokens: list[str]) -> list[bytes]:
        return [np.array(self.merge(t.encode("utf-8", "replace")), self.dtype).tobytes() for t in tokens]

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 100:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, for pieces where looking at all pairs again would be quadratic."""
        import heapq

        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged into an earlier one
        before = list(range(-1, n - 1))
        heap = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and at which byte each id's begin."""
        parts = [self.bytes_of[i] for i in ids.tolist()]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return b"".join(parts), np.cumsum(lengths) - lengths
