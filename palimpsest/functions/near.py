"""Places of a text's words that equal, or sound like, words of its record's roster: Arrow batches in, rows of places out.

Spark has no join by likeness. Lengths and sets of letters, a block of keys at a time, leave few of the pairs of a record. Where its
words times its values are many, keys meet instead by what is left of both when some letters are deleted, and long ones by equal
parts, so that work grows with the words. Either way no pair within the tolerance is missed, and only such pairs are handed out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .text import ASCII_DROPPED, ASCII_RULES, KEY_RULES, LONG, SHORT, fold_word

#: Pairs of a record up to which lengths and letters are compared pair by pair, and pairs of a block.
PAIRS, BLOCK = 20_000_000, 250_000
#: Keys up to this length meet by deletions, longer ones by parts.
DELETED = 16
#: Words that a worker remembers, and texts of a batch that it holds as Python's at once.
REMEMBERED, PIECE = 300_000, 256
FOUND = "pos int, start int, len int, word string, key string, gap string, goal int"
#: Characters of which Python and Spark may not say the same of what a word is: numbers that are no digits, and all beyond the Latin
#: blocks and common punctuation. Texts without any are cut into words here. A few ranges, since each costs every character.
FAR = r"\x{B2}-\x{BE}\x{250}-\x{200F}\x{2028}-\x{10FFFF}"
_CUT = re.compile(r"([^\W_]+(?:['’\-‐][^\W_]+)*)")
_KEY_RULES = [(re.compile(r"h|[\W_]" if p.startswith("h|") else p), to) for p, to in KEY_RULES]

_TABLE = str.maketrans("yvwzj", "IBBSY", ASCII_DROPPED)
_TWICE = re.compile(r"([^0-9])\1+")


def ascii_key(word: str) -> str:
    """`text.phonetic_key` of a word of ASCII."""
    out = word.lower()
    for literal, to in ASCII_RULES:
        out = out.replace(literal, to)
    out = ("^" + out.translate(_TABLE)).replace("^x", "^S").replace("x", "KS")[1:]
    return _TWICE.sub(r"\1", out.lower())


def plain_key(word: str) -> str:
    """`text.phonetic_key` of a word without characters of FAR."""
    out = fold_word(word)
    if out.isascii():
        return ascii_key(out)
    for pattern, to in _KEY_RULES:
        out = pattern.sub(to, out)
    return _TWICE.sub(r"\1", out.lower())


def edits(key: str) -> int:
    return 0 if len(key) < SHORT else 1 if len(key) < LONG else 2


def deletions(key: str, most: int) -> set[str]:
    """What is left of a key when up to `most` letters are deleted."""
    out = {key}
    if most:
        once = {key[:i] + key[i + 1 :] for i in range(len(key))}
        out |= once
        if most > 1:
            for x in once:
                out.update(x[:i] + x[i + 1 :] for i in range(len(x)))
    return out


def _parts(n: int) -> tuple[tuple[int, int], ...]:
    a, b = n // 3, n - n // 3
    return (0, a), (a, b), (b, n)


def within(a: str, b: str, most: int) -> bool:
    """Whether a becomes b by at most two edits or fewer."""
    if a == b:
        return True
    if not most or abs(len(a) - len(b)) > most:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b, n = a[i:], b[i:], n - i
    i = 0
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if max(len(a), len(b)) <= most:
        return True
    return most > 1 and (within(a[1:], b[1:], most - 1) or within(a[1:], b, most - 1) or within(a, b[1:], most - 1))


def letters(key: str) -> tuple[int, int]:
    """A bit for each letter (of 64 classes) that stands in a key an odd number of times, and one for each pair of neighbours. An
    edit changes two bits of the first at most, and four of the second."""
    one = two = last = 0
    for c in map(ord, key):
        one ^= 1 << (c & 63)
        if last:
            two ^= 1 << (last * 37 + c * 11 & 63)
        last = c
    return one, two


class Near:
    """The goals of a record, and which of them each of its keys sounds like."""

    def __init__(self, goals: Iterable[str]):
        self.goals = sorted(goals, key=len)

    def met(self, keys: list[str], sizes: np.ndarray | None = None, masks: np.ndarray | None = None) -> dict[str, list[str]]:
        """`sizes` and `masks` of the keys, where they are known."""
        if len(keys) * len(self.goals) > PAIRS:
            pairs = self._blocked(keys)
        elif sizes is None or masks is None:
            pairs = self._compared(keys, np.fromiter(map(len, keys), np.int32, len(keys)), _masks(keys))
        else:
            pairs = self._compared(keys, sizes, masks)
        out: dict[str, list[str]] = {}
        for key, goal, most in pairs:
            if most == SURE or key == goal or within(key, goal, most):
                out.setdefault(key, []).append(goal)
        return out

    def _compared(self, keys: list[str], sizes: np.ndarray, masks: np.ndarray) -> Iterator[tuple[str, str, int]]:
        t_sizes, t_masks = np.fromiter(map(len, self.goals), np.int32, len(self.goals)), _masks(self.goals)
        step = max(1, BLOCK // max(len(self.goals), 1))
        for at in range(0, len(keys), step):
            n, mask = sizes[at : at + step, None], masks[at : at + step]
            least = np.minimum(n, t_sizes)
            most = (least >= SHORT).view(np.int8) + (least >= LONG).view(np.int8)
            x, y = np.nonzero((np.abs(n - t_sizes) <= most) & (np.bitwise_count(mask[:, :1] ^ t_masks[:, 0]).view(np.int8) <= 2 * most))
            most = most[x, y]
            close = np.bitwise_count(mask[x, 1] ^ t_masks[y, 1]).view(np.int8) <= 4 * most
            x, y, most = x[close], y[close], most[close]
            # Of short keys the letters that both begin and end with tell at once whether one edit parts them.
            short = (most == 1) & (mask[x, 2] != 0) & (t_masks[y, 2] != 0)
            same = _equal_bytes(mask[x, 2] ^ t_masks[y, 2]) + _equal_bytes(mask[x, 3] ^ t_masks[y, 3]) >= np.maximum(n[x, 0], t_sizes[y]) - 1
            most[short] = np.where(same[short], SURE, -2)
            close = most > -2
            for i, j, m in zip((at + x[close]).tolist(), y[close].tolist(), most[close].tolist(), strict=True):
                yield keys[i], self.goals[j], m

    def _blocked(self, keys: list[str]) -> Iterator[tuple[str, str, int]]:
        left: dict[str, list[str]] = {}
        parts: dict[tuple[int, int, str], list[str]] = {}
        for goal in self.goals:
            if len(goal) <= DELETED:
                for x in deletions(goal, edits(goal)):
                    left.setdefault(x, []).append(goal)
            else:
                for i, (a, b) in enumerate(_parts(len(goal))):
                    parts.setdefault((len(goal), i, goal[a:b]), []).append(goal)
        for key in keys:
            met: set[str] = set()
            if len(key) <= DELETED + 2:
                for x in deletions(key, edits(key)):
                    met.update(left.get(x, ()))
            if parts and len(key) >= DELETED - 1:
                for n in range(len(key) - 2, len(key) + 3):
                    for i, (a, b) in enumerate(_parts(n)):
                        for at in range(max(0, a - 2), a + 3):
                            met.update(parts.get((n, i, key[at : at + b - a]), ()))
            for goal in met:
                yield key, goal, min(edits(key), edits(goal))


#: Instead of a number of edits: the pair is within the tolerance.
SURE = -1


def packed(key: str) -> tuple[int, int]:
    """A key of up to eight letters of ASCII as bytes of a number, from its start and from its end; zeros for any other."""
    return (int.from_bytes(key.encode(), "little"), int.from_bytes(key[::-1].encode(), "little")) if len(key) <= 8 and key.isascii() else (0, 0)


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the lowest bytes are zero."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).view(np.int8) >> 3


_MASKS: dict[str, tuple[int, ...]] = {}


def _mask(key: str) -> tuple[int, ...]:
    out = _MASKS.get(key)
    if out is None:
        if len(_MASKS) >= REMEMBERED:
            _MASKS.clear()
        out = _MASKS[key] = (*letters(key), *packed(key))
    return out


def _masks(keys: list[str]) -> np.ndarray:
    return np.array([_mask(k) for k in keys], np.uint64).reshape(-1, 4)


class Exact:
    def __init__(self, goals: Iterable[str]):
        self.goals = set(goals)

    def met(self, keys: list[str], sizes: np.ndarray | None = None, masks: np.ndarray | None = None) -> dict[str, list[str]]:
        return {k: [k] for k in keys if k in self.goals}


class Words:
    """Words seen, each with the number of its key; of a key its size and letters."""

    def __init__(self, key: Callable[[str], str]):
        self.key = key
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.number: dict[str, int] = {}
        self.keys: list[str] = []
        self.sizes, self.masks = np.zeros(1024, np.int32), np.zeros((1024, 4), np.uint64)

    def numbers(self, words: list[str], odd: dict[str, str]) -> np.ndarray:
        """The key's number of each word; `odd` holds keys that Spark has worked out."""
        fresh = set(words).difference(self.of)
        if self.of and len(self.of) + len(fresh) > REMEMBERED:
            self.clear()
            return self.numbers(words, odd)
        if fresh:
            was = len(self.keys)
            for w in fresh:
                key = odd[w] if w in odd else self.key(w)
                i = self.of[w] = self.number.setdefault(key, len(self.keys))
                if i == len(self.keys):
                    self.keys.append(key)
            self._measure(was)
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))


    def _measure(self, was: int) -> None:
        """Sizes of the keys from `was` on, and what `letters` and `packed` give of them, all in one go."""
        keys, n = self.keys[was:], len(self.keys)
        while n > len(self.sizes):
            self.sizes, self.masks = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.masks, np.zeros_like(self.masks)])
        self.sizes[was:n] = sizes = np.fromiter(map(len, keys), np.int32, len(keys))
        self.masks[was:n] = 0
        codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes):
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            one = np.uint64(1)
            pairs = one << (np.concatenate([codes[:1], codes[:-1]]) * np.uint64(37) + codes * np.uint64(11) & np.uint64(63))
            pairs[first] = 0
            rows = was + np.flatnonzero(sizes > 0)
            long = sizes[sizes > 0]
            at = np.arange(len(codes)) - np.repeat(first, long)
            fits = (long <= 8) & (np.maximum.reduceat(codes, first) < 128)
            for column, shift in ((2, at), (3, np.repeat(long, long) - 1 - at)):
                number = np.bitwise_or.reduceat(codes << (np.uint64(8) * np.minimum(shift, 7).astype(np.uint64)), first)
                self.masks[rows, column] = np.where(fits, number, 0)
            self.masks[rows, 0], self.masks[rows, 1] = np.bitwise_xor.reduceat(one << (codes & np.uint64(63)), first), np.bitwise_xor.reduceat(pairs, first)


#: By the function that gives keys: a worker keeps them from task to task.
_WORDS: dict[str, Words] = {}


def _parts_of(text: str, words: list[str] | None) -> list[str]:
    """A text's words, each between its gaps. A gap holds no letter, so that the next of given words stands where it is first found."""
    if words is None:
        return _CUT.split(text)
    out, at = [], 0
    for word in words:
        start = text.index(word, at)
        out += (text[at:start], word)
        at = start + len(word)
    return [*out, text[at:]]


def _hits(seen: Words, numbers: np.ndarray, goals: list[str], kind: type) -> dict[int, list[int]]:
    """The places of the goals that the keys of these numbers meet."""
    by: dict[str, list[int]] = {}
    for j, goal in enumerate(goals):
        by.setdefault(goal, []).append(j)
    numbers = numbers[seen.sizes[numbers] > 0]
    met = kind(by).met([seen.keys[i] for i in numbers.tolist()], seen.sizes[numbers], seen.masks[numbers])
    return {seen.number[k]: [j for g in gs for j in by[g]] for k, gs in met.items()}


def found(key: Callable[[str], str], kind: type, texts: pa.Array, words: pa.Array, odd: pa.Array, goals: pa.Array) -> pa.Array:
    """Of each text: a list of FOUND, in which `goal` is the place of the goal from 0; equal goals are each found. `words` are a text's
    words in order, or null where it has no character of FAR, `odd` (w, k) of those that are not ASCII; `key` gives the key of
    all others."""
    seen = _WORDS.setdefault(key.__name__, Words(key))
    ends, rows = [0], ([], [], [], [], [], [], [])
    at, start, size, word, sound, gap, goal = rows
    for i in range(0, len(texts), PIECE):
        for text, own, far, aims in zip(*(x.slice(i, PIECE).to_pylist() for x in (texts, words, odd, goals)), strict=True):
            parts = _parts_of(text, own) if aims else []
            mine = parts[1::2]
            if mine:
                numbers = seen.numbers(mine, {x["w"]: x["k"] for x in far or ()})
                unique, back = np.unique(numbers, return_inverse=True)
                hits = _hits(seen, unique, aims, kind)
                there = np.flatnonzero(np.isin(unique, np.fromiter(hits, np.int64, len(hits)))[back])
                begins = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[2 * there]
                for p, b, n in zip(there.tolist(), begins.tolist(), numbers[there].tolist(), strict=True):
                    for j in hits[n]:
                        at.append(p)
                        start.append(b)
                        size.append(len(mine[p]))
                        word.append(mine[p])
                        sound.append(seen.keys[n])
                        gap.append(parts[2 * p + 2])
                        goal.append(j)
            ends.append(len(at))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
    columns = [pa.array(c, t) for c, t in zip(rows, types, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")]))


def places(key: Callable[[str], str], kind: type) -> Callable[[pa.Array, pa.Array, pa.Array, pa.Array], pa.Array]:
    """`found` as an Arrow function. It is a name of this module that is sent to workers, not a copy of what they remember."""
    return lambda texts, words, odd, goals: found(key, kind, texts, words, odd, goals)
