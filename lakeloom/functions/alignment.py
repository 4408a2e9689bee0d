"""Alignments of token sequences, in numpy, and their Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_UNIT = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+(?:'[^\W_぀-ヿ㐀-鿿가-힯]+)*")


def units(text: str | None) -> list[str]:
    """Ideographs, kana and syllables one by one, other words whole, apostrophes inside included; compatibility form,
    lower case."""
    return _UNIT.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def strip_accents(text: str | None) -> str | None:
    """Decomposed, without accents; punctuation as spaces, spaces collapsed, lower case."""
    if text is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub(r"[\W_]+", " ", bare).strip().lower()


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    ids: dict = {}
    return np.array([ids.setdefault(x, len(ids)) for x in a], np.int64), np.array([ids.setdefault(x, len(ids)) for x in b], np.int64)


def distance_table(ref: list, hyp: list, free_ends: bool = False) -> np.ndarray:
    """Edit distances of all prefixes; with ``free_ends`` the reference may start anywhere in the hypothesis."""
    a, b = _codes(ref, hyp)
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), np.int64)
    d[:, 0] = np.arange(n + 1)
    if not free_ends:
        d[0] = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.minimum(d[i - 1, 1:] + 1, d[i - 1, :-1] + (b != a[i - 1]))
        # Deletions along the row: the least of all earlier entries plus their distance.
        d[i] = np.minimum.accumulate(np.r_[d[i, 0], row] - steps) + steps
    return d


def _last_row(ref: list, hyp: list, free_ends: bool) -> list[int]:
    """Edit distances of the whole reference to every prefix of the hypothesis, one word of differences a column."""
    n, at = len(ref), {}
    for i, x in enumerate(ref):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n >> 1
    up, down, score = full, 0, n
    out = [n]
    for x in hyp:
        same = at.get(x, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(level | up)), up & level
        score += bool(more & top) - bool(less & top) if n else not free_ends
        more, less = (more << 1 | (not free_ends)) & full, less << 1 & full
        up, down = less | (full & ~(level | more)), more & level
        out.append(score)
    return out


def edit_distance(ref: list, hyp: list) -> int:
    return _last_row(ref, hyp, False)[-1]


def accuracy(ref: str | None, hyp: str | None) -> float:
    """1 - edits by reference units, at least 0; 1 or 0 for an empty reference, as the hypothesis is empty or not."""
    r, h = units(ref), units(hyp)
    return max(0.0, 1 - edit_distance(r, h) / len(r)) if r else float(not h)


def repeated_grams(text: str, n: int = 8) -> float:
    """The share of character n-grams of the text's units that occur before in it; 0 for fewer than ``n`` characters."""
    t = "".join(units(text)).replace("'", "")
    total = len(t) - n + 1
    return 1 - len({t[i : i + n] for i in range(total)}) / total if total > 0 else 0.0


def semi_global(ref: list, hyp: list) -> int:
    """The least edits between the reference and any stretch of the hypothesis."""
    return min(_last_row(ref, hyp, True))


def lcs_ratio(a: list, b: list) -> float:
    """Twice the longest common subsequence by both lengths; 0 if either is empty."""
    if not a or not b:
        return 0.0
    x, y = _codes(a, b)
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        take = np.where(y == c, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], take))
    return 2 * int(row[-1]) / (len(a) + len(b))


def indel_similarity(a: str, b: str) -> float:
    """``lcs_ratio`` of characters, with the subsequence's length by bits of one whole number."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        both = row & at.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial_ratio(short: str, long: str) -> float:
    """1 - the semi-global distance by length of the shorter text; 0 if either is empty."""
    if len(short) > len(long):
        short, long = long, short
    return max(0.0, 1 - semi_global(list(short), list(long)) / len(short)) if short else 0.0


def alignment(ref: list, hyp: list) -> list[tuple[str, int, int]]:
    """Steps ('=', 'sub', 'del', 'ins') with the positions in both, in order."""
    d = distance_table(ref, hyp)
    i, j, out = len(ref), len(hyp), []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append(("=" if ref[i] == hyp[j] else "sub", i, j))
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
            out.append(("del", i, j))
        else:
            j -= 1
            out.append(("ins", i, j))
    return out[::-1]


def aligned_span(ref: list, hyp: list, start: int, end: int) -> list:
    """What the hypothesis has where the reference has [start, end)."""
    return [hyp[j] for op, i, j in alignment(ref, hyp) if op in ("=", "sub") and start <= i < end or op == "ins" and start < i < end]


def target_outcome(ref: list, hyp: list, start: int, end: int, alt: list) -> str:
    """``gold`` if the hypothesis has the reference's own units at [start, end), ``alt`` if it has the confusable ones that
    the context rules out (none if empty), else ``other``."""
    written = aligned_span(ref, hyp, start, end)
    return "gold" if written == ref[start:end] else "alt" if alt and written == alt else "other"


def context_score(outcomes: list[str]) -> float | None:
    """The mean over targets of 1 for gold, -1 for alt and 0 for other; None without targets."""
    return sum((o == "gold") - (o == "alt") for o in outcomes) / len(outcomes) if outcomes else None


def charged_edits(ref_owners: list, ref: list, hyp: list) -> dict:
    """Edits per owner of the reference tokens; an insertion is charged to the owner before it, or the first."""
    out = {o: 0 for o in ref_owners}
    for op, i, _ in alignment(ref, hyp):
        if op != "=" and ref_owners:
            out[ref_owners[i if op != "ins" else max(0, i - 1)]] += 1
    return out


def best_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, each used once (Hungarian method with potentials)."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            row = match[col]
            free = np.flatnonzero(~used[1:]) + 1
            now = c[row - 1, free - 1] - u[row] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], col
            nxt = free[least[free].argmin()]
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[way[col]]
            col = way[col]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def speaker_mapping(ref: dict[str, list], hyp: dict[str, list]) -> tuple[dict[str, str], int]:
    """Hypothesis speaker of each reference speaker, pairs kept only where they save edits, and the total edits."""
    rs, hs = list(ref), list(hyp)
    cost = np.array([[edit_distance(ref[r], hyp[h]) - len(ref[r]) - len(hyp[h]) for h in hs] for r in rs]).reshape(len(rs), len(hs))
    kept = {rs[i]: hs[j] for i, j in best_assignment(cost) if cost[i, j] < 0}
    total = sum(map(len, ref.values())) + sum(map(len, hyp.values())) + sum(int(cost[rs.index(r), hs.index(h)]) for r, h in kept.items())
    return kept, total


# Words that carry no content, weights of the score, penalties by length, and thresholds.
STOPWORDS = frozenset("a an the of in on at to for and or is was are were be been has had do did not no but by with from as it its he she we they his her my this that which who what how all each".split())
PENALTY = {3: 0.35, 4: 0.20, 5: 0.10}
LEAST_SIMILAR, LEAST_COMMON, LEAST_RATIO = 0.65, 0.60, 1.30


def partial_similarity(word: str, text: str) -> float:
    """The best indel similarity of the shorter text to a stretch of the longer one, of its length or cut off at an end."""
    short, long = (word, text) if len(word) <= len(text) else (text, word)
    n = len(short)
    if not n:
        return 0.0
    inside = [long[i : i + n] for i in range(len(long) - n + 1)]
    ends = [long[:i] for i in range(1, n)] + [long[-i:] for i in range(1, n)]
    return max(indel_similarity(short, x) for x in inside + ends)


def common_share(word: str, text: str) -> float:
    """The longest common subsequence by the word's length."""
    return indel_similarity(word, text) * (len(word) + len(text)) / 2 / len(word) if word and text else 0.0


def content_share(word: str, text: str) -> float:
    """The share of a word's parts that carry content and are words of the text; of one without any 1 if all are there."""
    parts, known = set(word.split()), set(text.split())
    content = parts - STOPWORDS
    return len(content & known) / len(content) if content else float(bool(parts) and parts <= known)


def alphabetic_score(word: str, text: str) -> tuple[float, float, float, float, bool, int]:
    """(score, similarity, common share, content share, contained, length) of a hotword for an alphabetic text."""
    w, t = strip_accents(word), strip_accents(text)
    bare, plain = w.replace(" ", ""), t.replace(" ", "")
    shares = content_share(w, t), partial_similarity(bare, plain), common_share(bare, plain)
    contained = bool(bare) and bare in plain
    score = 3.0 * contained + 2.0 * shares[0] + 1.5 * shares[1] + 0.5 * shares[2] - PENALTY.get(max(3, len(bare)), 0.0)
    return score, shares[1], shares[2], shares[0], contained, len(bare)


def _verified(word: str, similar: float, common: float, content: float, contained: bool, n: int) -> bool:
    if n <= 4:
        return contained or content >= 1
    if content >= 0.8 or contained:
        return True
    strict = n == 5 and content == 0
    if similar < (0.75 if strict else LEAST_SIMILAR) or common < (0.70 if strict else LEAST_COMMON):
        return False
    several = len((strip_accents(word) or "").split()) >= 2 and content < 0.01
    return not several or (similar >= 0.80 and common >= 0.75)


def alphabetic_hotwords(words: list[str], text: str | None, most: int = 16) -> list[str]:
    """The listed words a text supports, best first, at most ``most``; the first of the list for an empty text.

    None if the best of ten or more scores less than LEAST_RATIO times the tenth: then nothing stands out. Short words
    must be there, longer ones be similar enough. Equal scores keep the list's order.
    """
    if not text or not text.strip():
        return words[:most]
    scored = sorted(((alphabetic_score(w, text), w) for w in words), key=lambda x: -x[0][0])
    if len(scored) >= 10 and scored[9][0][0] > 0 and scored[0][0][0] / scored[9][0][0] < LEAST_RATIO:
        return []
    return [w for s, w in scored if _verified(w, *s[1:])][:most]


def batched(f: Callable, kind: str):
    """A scalar function of one or two values as an Arrow-batched column function; null arguments give null."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])

    return run


def syllables(text: str, table: dict[str, str]) -> list[str]:
    """Characters by their pronunciation in a given table, others as they are."""
    return [table.get(c, c) for c in text]


def sounds_like(word: str, text: str, table: dict[str, str]) -> float:
    """The largest share of a word's syllables that a stretch of the text of its length has in place; 0 if it is shorter."""
    w, t = syllables(word, table), syllables(text, table)
    if not w or len(t) < len(w):
        return 0.0
    return max(sum(a == b for a, b in zip(w, t[i : i + len(w)])) for i in range(len(t) - len(w) + 1)) / len(w)
