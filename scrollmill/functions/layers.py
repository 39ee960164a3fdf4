"""Texts without their layers of encoding, and the way back to what was written.

A known value may stand in a text behind backslashes, as URL or HTML escapes, as
``\\uXXXX``, broken over lines, and in several of these at once. ``peel`` takes
the layers off, round by round until nothing changes, and keeps for each round
where every piece came from; ``Finder`` looks for many values in the peeled text,
by a gram that a value shares with all its long fragments, and gives the places in
the text as written.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np

NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " "}
ROUNDS = 6
#: One encoded piece: a pair of surrogates, \\uXXXX, percent bytes, an entity, a
#: broken line, backslashes.
PIECE = re.compile(
    r"\\+u(?P<high>[dD][89abAB][0-9a-fA-F]{2})\\+u(?P<low>[dD][c-fC-F][0-9a-fA-F]{2})|\\+u(?P<unit>[0-9a-fA-F]{4})|(?P<url>(?:%[0-9A-Fa-f]{2})+)"
    r"|&(?:#(?P<dec>[0-9]{1,7})|#[xX](?P<hex>[0-9a-fA-F]{1,6})|(?P<name>amp|quot|apos|lt|gt|nbsp));|(?P<gap>\\*\r?\n[ \t]*|\\+r?\\*n)|(?P<slash>\\+)"
)
#: What a piece begins with: most characters are passed by this alone.
BEGIN = re.compile(r"[\\%&\r\n]")
#: Marks that shells double.
TWICE = re.compile(r"([^\w\s])\1+")
#: Codes that may be such a mark; all beyond ASCII may.
MARKS = np.array([bool(re.match(r"[^\w\s]", chr(c))) for c in range(128)] + [True])


def _char(code: int) -> str | None:
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def _read(m: re.Match) -> list[tuple[str, int, int]] | None:
    """What a piece stands for, each with its place; None if it stands for itself."""
    a, b = m.span()
    if m["gap"] or m["slash"]:
        return [("", a, b)]
    if m["high"]:
        return [(chr(0x10000 + ((int(m["high"], 16) - 0xD800) << 10) + int(m["low"], 16) - 0xDC00), a, b)]
    if m["url"]:
        try:
            read = bytes.fromhex(m["url"].replace("%", "")).decode()
        except UnicodeDecodeError:
            return None
        out = []
        for c in read:
            out.append((c, a, a := a + 3 * len(c.encode())))
        return out
    c = _char(int(m["unit"], 16)) if m["unit"] else _char(int(m["dec"])) if m["dec"] else _char(int(m["hex"], 16)) if m["hex"] else NAMED[m["name"]]
    return None if c is None else [(c, a, b)]


class Round:
    """One round of peeling: the new text, and for stretches of it their origin."""

    def __init__(self, text: str, found: list[tuple[str, int, int]]):
        parts, self.at, self.spans, done, n = [], [], [], 0, 0
        for part, a, b in [*found, ("", len(text), len(text))]:
            if a > done:
                self.at.append(n)
                self.spans.append((done, a, True))
                parts.append(text[done:a])
                n += a - done
            if part:
                self.at.append(n)
                self.spans.append((a, b, len(part) == b - a))
                parts.append(part)
                n += len(part)
            done = b
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The place in the text before of [start, end) of the new one."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, _, same = self.spans[i]
        c, d, as_is = self.spans[j]
        return a + (start - self.at[i] if same else 0), c + end - self.at[j] if as_is else d


def _pieces(text: str):
    at = BEGIN.search(text)
    while at:
        m = PIECE.match(text, at.start())
        if m:
            yield m
        at = BEGIN.search(text, m.end() if m else at.end())


def _doubles(text: str) -> bool:
    """Whether a mark may stand twice in a row."""
    codes = _units(text)
    return bool(MARKS[np.minimum(codes[1:][codes[1:] == codes[:-1]], 128)].any())


def peel(text: str, rounds: int = ROUNDS) -> list[Round]:
    """The rounds that change ``text``, then one that takes doubled marks once."""
    out: list[Round] = []
    for _ in range(rounds):
        found = [x for m in _pieces(text) for x in _read(m) or ()]
        if not found:
            break
        out.append(Round(text, found))
        text = out[-1].text
    doubled = [(m[1], m.start(), m.end()) for m in TWICE.finditer(text)] if _doubles(text) else []
    return [*out, Round(text, doubled)] if doubled else out


def _written(m: re.Match) -> str:
    read = _read(m)
    return m[0] if read is None else "".join(c for c, _, _ in read)


def unwrapped(text: str, rounds: int = ROUNDS) -> str:
    """``text`` without its layers, without the way back; doubled marks stay."""
    for _ in range(rounds):
        if not ("\\" in text or "%" in text or "&" in text):
            # Most texts have line ends and no other piece.
            first, *rest = text.replace("\r\n", "\n").split("\n")
            return first + "".join([x.lstrip(" \t") for x in rest]) if rest else text
        parts, done = [], 0
        for m in _pieces(text):
            parts += [text[done : m.start()], _written(m)]
            done = m.end()
        new = "".join([*parts, text[done:]])
        if len(new) == len(text):
            break
        text = new
    return text


def once(text: str) -> str:
    return TWICE.sub(r"\1", text) if _doubles(text) else text


def bare(text: str) -> str:
    return once(unwrapped(text))


#: What a fragment must hold, to be no word.
NO_WORD = re.compile("[^A-Za-z]")
#: Lengths of the grams by which values are looked up.
SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16)
FACTOR, WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
_FACTOR = np.uint64(FACTOR)
#: So many hashes are taken one by one.
FEW = 32


def shifts(log2_bits: int) -> list[int]:
    """By how much a hash is shifted for each of its places in a bitmap."""
    return [64 - log2_bits - x for x in (0, 13, 26)]


@lru_cache(1 << 12)
def span(n: int, share: float = 0.7, least: int = 8) -> tuple[int, int, int]:
    """(offset, size, shortest): where the gram of a value of ``n`` characters
    stands, the gram's length, and that of the shortest fragment."""
    shortest = max(least, -int(-share * n // 1))
    a, b = (n - shortest, shortest) if shortest < n else (0, n)
    return a, SIZES[bisect_right(SIZES, b - a) - 1], shortest


def heart(value: str) -> tuple[int, str, int]:
    """(offset, gram, shortest): a gram that the value and all its long fragments
    hold, where it stands in the value, and the length of the shortest fragment."""
    a, size, shortest = span(len(value))
    return a, value[a : a + size], shortest


def windows(value: str) -> list[str]:
    """The shortest fragments of a value, or the value if it has none: all its
    long fragments are made of such windows in a row."""
    width = min(len(value), span(len(value))[2])
    return [value[i : i + width] for i in range(len(value) - width + 1)]


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(text: str) -> np.ndarray:
    return _units(text).astype(np.uint64)


def hashes(grams: list[str]) -> np.ndarray:
    """A hash of each gram, as ``hashes_in`` has it."""
    out = np.zeros(len(grams), np.uint64)
    for size in {len(g) for g in grams}:
        own = [i for i, g in enumerate(grams) if len(g) == size]
        h = np.zeros(len(own), np.uint64)
        for column in _codes("".join(grams[i] for i in own)).reshape(-1, size).T:
            h = h * _FACTOR + column
        out[own] = h
    return out


def hashes_in(text: str, sizes: set[int]):
    """The hashes of all grams of a text, one array for each of ``sizes``."""
    codes = _codes(text)
    h = np.zeros(len(codes), np.uint64)
    for j in range(min(max(sizes, default=0), len(codes))):
        h = h[: len(codes) - j] * _FACTOR
        h += codes[j:]
        if j + 1 in sizes:
            yield h


def hashes_at(codes: np.ndarray, places: np.ndarray, sizes: set[int]):
    """(places, hashes) of the grams that begin at ``places`` of a text, as ``hashes_in`` has them."""
    h = np.zeros(len(places), np.uint64)
    for j in range(min(max(sizes, default=0), len(codes))):
        held = places + j < len(codes)
        places, h = places[held], h[held]
        h = h * _FACTOR + codes[places + j]
        if j + 1 in sizes:
            yield places, h


def heads(grams: list[str]) -> tuple[int, np.ndarray]:
    """(n, bits): for each low byte of a character's code at which of the first
    ``n`` places of a gram it stands, a bit each."""
    n = min(8, min(map(len, grams), default=0))
    bits = np.zeros(256, np.uint8)
    for j, column in enumerate(_units("".join(g[:n] for g in grams)).reshape(-1, max(n, 1)).T):
        bits[np.unique(column.astype(np.uint8))] |= np.uint8(1 << j)
    return n, bits


def marks(cut: list[str], n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each window, of the length ``n`` of its value and of its place ``at`` there."""
    return ((hashes(cut) * _FACTOR + n.astype(np.uint64)) * _FACTOR + at.astype(np.uint64)) * _FACTOR


_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)


class Sieve:
    """A bitmap of hashes of 2**log2_bits bits, and the sizes of their grams: it
    may let a strange gram pass and misses none. With the grams' ``heads`` only
    places whose characters may begin one are hashed."""

    def __init__(self, bits: np.ndarray, log2_bits: int, sizes: set[int], heads: tuple[int, np.ndarray] = (0, None)):
        self.bits, self.sizes, self.heads = bits, sizes, heads
        self.low, self.own = (1 << log2_bits) - 1, shifts(log2_bits)
        self.mask, self.shifts = np.uint64(self.low), [np.uint64(x) for x in self.own]

    def _holds(self, h: np.ndarray, shift: np.uint64) -> np.ndarray:
        at = h >> shift
        at &= self.mask
        return np.flatnonzero(self.bits[(at >> np.uint64(3)).view(np.int64)] & _BIT[(at & np.uint64(7)).view(np.int64)])

    @classmethod
    def of(cls, grams: list[str], log2_bits: int) -> Sieve:
        made = cls(np.zeros(1 << log2_bits - 3, np.uint8), log2_bits, {len(g) for g in grams}, heads(grams))
        for shift in made.shifts:
            at = (hashes(grams) >> shift & made.mask).view(np.int64)
            np.bitwise_or.at(made.bits, at >> 3, _BIT[at & 7])
        return made

    def among(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes pass."""
        found = self._holds(h, self.shifts[0])
        for shift in self.shifts[1:]:
            found = found[self._holds(h[found], shift)]
        return found

    def holds(self, h: int) -> bool:
        """Whether one hash passes."""
        return all(self.bits.item((at := h >> s & self.low) >> 3) >> (at & 7) & 1 for s in self.own)

    def _each(self, places: list[int], codes: np.ndarray):
        """As ``passed``, of a few places: without arrays, which cost more than so few hashes."""
        most = max(self.sizes)
        found = {size: ([], []) for size in sorted(self.sizes)}
        for at in places:
            h = 0
            for j, c in enumerate(codes[at : at + most].tolist()):
                h = h * FACTOR + c & WORD
                if j + 1 in found and self.holds(h):
                    found[j + 1][0].append(at)
                    found[j + 1][1].append(h)
        for own, hs in found.values():
            yield np.array(own, np.int64), np.array(hs, np.uint64)

    def passed(self, text: str):
        """(places, hashes) of the grams of a text that pass, for each size."""
        n, bits = self.heads
        if n and len(text) >= n:
            codes = _units(text)
            own, last = bits[codes.astype(np.uint8)], len(codes) - n + 1
            begins = own[:last] & 1
            for j in range(1, n):
                begins &= own[j : last + j] >> j
            places = np.flatnonzero(begins)
            if len(places) <= FEW:
                yield from self._each(places.tolist(), codes)
                return
            if 8 * len(places) <= len(codes):
                for at, h in hashes_at(codes, places, self.sizes):
                    found = self.among(h)
                    yield at[found], h[found]
                return
        for h in hashes_in(text, self.sizes):
            found = self.among(h)
            yield found, h[found]


class Seeker:
    """Stretches of a text that may be known values or long fragments of them, told
    by bitmaps of the values' grams and marks and by the values' lengths."""

    def __init__(self, grams: Sieve, windows: Sieve, lengths: set[int]):
        self.grams, self.windows = grams, windows
        self.lengths: dict[int, list[int]] = {}
        for n in sorted(lengths):
            self.lengths.setdefault(span(n)[1], []).append(n)

    def _held(self, near: str, n: int, first: int, width: int) -> list[int]:
        """Where the windows of a stretch stand whose marks pass."""
        codes, h, out = list(map(ord, near)), 0, []
        top = pow(FACTOR, width - 1, 1 << 64)
        for i, c in enumerate(codes):
            h = h * FACTOR + c & WORD
            at = i - width + 1
            if at >= 0:
                if self.windows.holds(((h * FACTOR + n) * FACTOR + at + first) * FACTOR & WORD):
                    out.append(at)
                h = h - codes[at] * top & WORD
        return out

    def __call__(self, text: str) -> set[tuple[int, int, str]]:
        """(hash of the gram, length of the value, stretch): windows in a row that
        pass, where the gram of a value of that length stands."""
        out, seen = set(), set()
        for size, (places, found) in zip(sorted(self.grams.sizes), self.grams.passed(text), strict=False):
            for place, h in zip(places.tolist(), found.view("int64").tolist(), strict=True):
                for n in self.lengths[size]:
                    offset, _, shortest = span(n)
                    begin, width = max(0, place - offset), min(n, shortest)
                    first, near = begin - (place - offset), text[begin : place - offset + n]
                    if len(near) < width or (n, first, near) in seen:
                        continue
                    seen.add((n, first, near))
                    row = []
                    for at in [*self._held(near, n, first, width), None]:
                        if row and at != row[-1] + 1:
                            out.add((h, n, near[row[0] : row[-1] + width]))
                            row = []
                        row.append(at)
        return out


class Finder:
    """Places of many known values, and of their long fragments, in a text. Values
    that are ``plain`` have no layers left."""

    def __init__(self, values: list[str], plain: bool = False):
        self.values = {v if plain else bare(v) for v in values} - {""}
        self.hearts: dict[str, list[tuple[str, int, int]]] = {}
        for v in self.values:
            offset, gram, shortest = heart(v)
            self.hearts.setdefault(gram, []).append((v, offset, shortest))
        grams = list(self.hearts)
        self.sieve = Sieve.of(grams, max(12, (32 * len(grams)).bit_length())) if len(grams) > 64 else None

    def _grams(self, text: str):
        """(place, gram) of the values' grams."""
        if self.sieve is None:
            for g in self.hearts:
                at = text.find(g)
                while at >= 0:
                    yield at, g
                    at = text.find(g, at + 1)
        else:
            for size, (places, _) in zip(sorted(self.sieve.sizes), self.sieve.passed(text), strict=False):
                for at in places.tolist():
                    if (g := text[at : at + size]) in self.hearts:
                        yield at, g

    def _hits(self, text: str) -> list[tuple[int, int, str]]:
        whole, parts = set(), set()
        for at, g in self._grams(text):
            for v, offset, shortest in self.hearts[g]:
                a, b = at - offset, at - offset + len(v)
                if a >= 0 and text.startswith(v, a):
                    whole.add((a, b))
                else:
                    # As far to both sides as text and value agree.
                    a, b = at, at + len(g)
                    while a > 0 and at - a < offset and text[a - 1] == v[offset - (at - a) - 1]:
                        a -= 1
                    while b < len(text) and offset + b - at < len(v) and text[b] == v[offset + b - at]:
                        b += 1
                if shortest < len(v) and b - a >= shortest:
                    parts.add((a, b, shortest))
        # Whole values first, then fragments where none is; the first and longest of what overlaps.
        taken, end = [], 0
        for a, b in sorted(whole, key=lambda x: (x[0], -x[1])):
            if a >= end:
                taken.append((a, b, "known"))
                end = b
        # What the taken leave free of a stretch may hold a shorter fragment.
        gaps = list(zip([0, *(b for _, b, _ in taken)], [*(a for a, _, _ in taken), len(text)], strict=True))
        begins = [a for a, _ in gaps]
        free = []
        for a, b, shortest in parts:
            for low, high in gaps[max(0, bisect_right(begins, a) - 1) : bisect_right(begins, b)]:
                if min(b, high) - max(a, low) >= shortest:
                    heappush(free, (max(a, low), -min(b, high), shortest))
        end = 0
        while free:
            a, b, shortest = heappop(free)
            if a < end:
                if -b - end >= shortest:
                    heappush(free, (end, b, shortest))
            elif NO_WORD.search(text, a, -b):
                taken.append((a, -b, "known_part"))
                end = -b
        return sorted(taken)

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in the text as written, in order."""
        hits = self._hits(bare(text)) if self.values else []
        # Only a text with a hit needs the way back.
        rounds = peel(text) if hits else []
        out = []
        for a, b, kind in hits:
            for r in reversed(rounds):
                a, b = r.back(a, b)
            if out and a < out[-1][1]:
                a = out[-1][1]
            if a < b:
                out.append((a, b, kind))
        return out

    def mask(self, text: str) -> str:
        done, parts = 0, []
        for a, b, kind in self(text):
            parts += [text[done:a], f"[REDACTED:{kind}]"]
            done = b
        return "".join([*parts, text[done:]]) if parts else text
