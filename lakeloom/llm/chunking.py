"""Problem 8: oversized documents into pieces under a limit, cut at natural boundaries, with an overlap."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.packing import limits_of
from lakeloom.llm.tokens import encoding, read_vocabulary
from lakeloom.sources.tables import table

HASH_WINDOW, MIN_PART, SLACK = 16, 4, 4
PIECE_SCHEMA = "limit_name string, doc_id long, piece_no int, start_char int, end_char int, core_start int, tokens int, cut_at string, text string"

# Natural boundaries from strong to weak, and how far one may lie from a landmark relative to others.
BOUNDARIES = [("paragraph", 0.25), ("line", 0.5), ("sentence", 1.0), ("clause", 3.0), ("word", 6.0)]
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+|(?:\r\n|\n|\r)(?=#{1,6} )")
_CLAUSE_WIDE, _CLAUSE, _SENTENCE_WIDE, _SENTENCE, _CLOSING = 4, 8, 16, 32, 64
_MARKS = {_CLAUSE_WIDE: "，、：", _CLAUSE: ",:", _SENTENCE_WIDE: "。！？；…", _SENTENCE: ".!?;", _CLOSING: "”’」』）)]\"'"}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For every code point 0 other, 1 letter, 2 number or 3 space, and the bits of the marks it is one of."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = 1
        elif k == "N":
            out[c] = 2
    out[[c for c in range(0x3001) if chr(c).isspace()]] = 3
    for bit, marks in _MARKS.items():
        out[[ord(c) for c in marks]] |= bit
    return out


@lru_cache(maxsize=2)
def _token_bytes(enc) -> np.ndarray:
    """The length in bytes of every token of a vocabulary."""
    out = np.zeros(enc.max_token_value + 1, np.int64)
    for i in range(len(out)):
        try:
            out[i] = len(enc.decode_single_token_bytes(i))
        except KeyError:  # a free id
            continue
    return out


def boundary_kinds(text: str, code: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """For each place between characters the number of its strongest boundary in BOUNDARIES, from 1; 0 for none."""
    kind = np.zeros(len(code) + 1, np.int8)
    space = (cls & 3) == 3
    spaced = np.r_[space[1:], True]
    kind[1:-1][space[1:] & ~space[:-1]] = 5

    def after(ends: np.ndarray, k: int) -> None:
        at = np.flatnonzero(ends) + 1
        inner = at[at < len(code)]
        closed = inner[(cls[inner] & _CLOSING) != 0]
        kind[at] = np.where(np.r_[cls, np.uint8(0)][at] & _CLOSING, kind[at], k)
        kind[closed + 1] = k

    kind[np.flatnonzero((cls & _CLAUSE_WIDE != 0) | ((cls & _CLAUSE != 0) & spaced)) + 1] = 4
    closes = cls & _CLOSING != 0
    after((cls & _SENTENCE_WIDE != 0) | ((cls & _SENTENCE != 0) & (spaced | np.r_[closes[1:], False])), 3)
    line = (code == 10) | ((code == 13) & (np.r_[code[1:], 0] != 10)) | (code == 0x2028) | (code == 0x2029)
    kind[np.flatnonzero(line) + 1] = 2
    for m in _PARAGRAPH.finditer(text):
        kind[m.end()] = 1
    return kind


class Document:
    """A text as tokens: where each token may end a piece, what lies there, and a rolling hash of what precedes."""

    def __init__(self, text: str, enc, ids: list[int] | None = None):
        self.text, self.enc = text, enc
        self.ids = np.array(enc.encode_ordinary(text) if ids is None else ids, np.int64)
        raw = text.encode("utf-8", "replace")
        ends = np.r_[0, np.cumsum(_token_bytes(enc)[self.ids])]
        first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        chars = np.r_[0, np.cumsum(first)]
        whole = np.r_[first, True][ends]
        #: For each token boundary the character it lies before, -1 inside a character.
        self.char = np.where(whole, chars[ends], -1)
        self.n = len(self.ids)
        h = np.zeros(self.n + 1, np.uint64)
        for j in range(min(HASH_WINDOW, self.n)):
            h[j + 1 :] += (self.ids[: self.n - j] + 1).astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        self.hash = h ^ (h >> np.uint64(33))
        code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        cls = _classes()[code]
        self.kind = np.where(self.char >= 0, boundary_kinds(text, code, cls)[np.maximum(self.char, 0)], 0)
        self.cost = np.array([np.inf, *(c for _, c in BOUNDARIES)])[self.kind]
        #: Token boundaries at which any text would be cut before its tokens are sought: there counts add up exactly.
        safe = np.zeros(len(code) + 1, bool)
        safe[0] = safe[-1] = True
        a, b, quote = cls[:-1] & 3, cls[1:] & 3, code == 0x27
        safe[1:-1] = (a != b) & ~quote[:-1] & ~quote[1:] & ((a != 3) | ((code[:-1] == 10) & (b != 3)))
        self.safe = (self.char >= 0) & safe[np.maximum(self.char, 0)]
        self.safe_at = np.flatnonzero(self.safe)

    def fresh(self, i: int, j: int) -> int:
        return len(self.enc.encode_ordinary(self.text[self.char[i] : self.char[j]]))

    def tokens(self, i: int, j: int) -> int:
        """Tokens of the text between two boundaries, taken alone. Only the stretches up to the next safe boundary,
        whose words are cut, are tokenized anew."""
        if i >= j:
            return 0
        k = np.searchsorted(self.safe_at, [i, j], side="left")
        a = int(self.safe_at[k[0]]) if k[0] < len(self.safe_at) else self.n
        b = j if k[1] < len(self.safe_at) and self.safe_at[k[1]] == j else int(self.safe_at[k[1] - 1])
        if a >= b:
            return self.fresh(i, j)
        return (b - a) + (self.fresh(i, a) if i < a else 0) + (self.fresh(b, j) if b < j else 0)

    def back(self, i: int) -> int:
        """The last boundary at or before ``i`` that lies between characters."""
        while self.char[i] < 0:
            i -= 1
        return i

    def pieces(self, capacity: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """(first, core start, end, tokens, kind of cut) as token boundaries."""
        overlap = max(0, min(overlap, capacity // 2))
        most = max(1, capacity - overlap - (SLACK if overlap else 0))
        least = max(1, most // MIN_PART)
        mask = np.uint64((1 << max(1, (most - least).bit_length() - 2)) - 1)
        out, core = [], 0
        while core < self.n:
            first = self.back(max(0, core - overlap)) if core else 0
            if self.n - core <= most:
                end, kind = self.n, 0
            else:
                end, kind = self._cut(core + least, core + most, mask)
                if end <= core:
                    end, kind = self._next(core), 0
            size = self.tokens(first, end)
            while size > capacity and end > core + 1:
                shorter = self.back(max(core + 1, end - max(1, size - capacity)))
                if shorter <= core:
                    break
                near = self._cut(core + least, shorter, mask) if shorter - core > least else (shorter, 0)
                end, kind = near if core < near[0] < end else (shorter, 0)
                size = self.tokens(first, end)
            while size > capacity and first < core:
                first = min(core, self._next(first))
                size = self.tokens(first, end)
            out.append((first, core, end, size, kind))
            core = end
        return out

    def _next(self, i: int) -> int:
        i += 1
        while i < self.n and self.char[i] < 0:
            i += 1
        return i

    def _cut(self, lo: int, hi: int, mask: np.uint64) -> tuple[int, int]:
        """The first landmark in [lo, hi], else ``hi``, moved to the nearest end of a sentence, line or paragraph, stronger
        ones counting as nearer; without one there to a clause, then to a word, then between characters."""
        marks = np.flatnonzero((self.hash[lo : hi + 1] & mask) == 0)
        mark = lo + int(marks[0]) if len(marks) else hi
        kind, cost = self.kind[lo : hi + 1], self.cost[lo : hi + 1]
        for weakest in (3, 4, 5):
            usable = (kind > 0) & (kind <= weakest)
            if usable.any():
                far = np.where(usable, (np.abs(np.arange(lo, hi + 1) - mark) + 1.0) * np.where(usable, cost, 0), np.inf)
                end = lo + int(far.argmin())
                return end, int(self.kind[end])
        return self.back(mark), 0


def split_text(text: str | None, capacity: int, overlap: int, enc) -> list[tuple[int, int, int, int, str]]:
    """(start_char, end_char, core_start, tokens, cut_at) of the pieces of a text; none for one within the capacity.

    The core of a piece follows that of the one before; from ``start_char`` it repeats the last ``overlap`` tokens. A
    piece exceeds the capacity only if a single character does.
    """
    if not text or len(text) <= capacity and len(text.encode("utf-8", "replace")) <= capacity:
        return []
    doc = Document(text, enc)
    if doc.n <= capacity:
        return []
    names = ["none", *(b[0] for b in BOUNDARIES)]
    got = doc.pieces(capacity, overlap)
    return [(int(doc.char[a]), int(doc.char[e]), int(doc.char[c]), size, "end" if e == doc.n else names[k]) for a, c, e, size, k in got]


def split_documents(documents: DataFrame, limits: list[tuple[str, int, int]], vocabulary: bytes | None = None) -> DataFrame:
    """The pieces of every document longer than a limit, per limit; no shuffle.

    Null, empty and shorter texts have none, nor have rows with a null doc_id. Equal documents are cut alike. Lone
    surrogates and other text that isn't UTF-8 can't occur in a Spark string.
    """
    data = vocabulary or read_vocabulary()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, least = encoding(data), min((c for _, c, _ in limits), default=0)
        names = ["none", *(b[0] for b in BOUNDARIES)]
        for p in batches:
            rows = []
            for doc_id, text in zip(p["doc_id"], p["text"]):
                if not limits or len(text.encode("utf-8", "replace")) <= least:
                    continue
                ids = enc.encode_ordinary(text)
                if len(ids) <= least:
                    continue
                doc = Document(text, enc, ids)
                for name, capacity, overlap in limits:
                    if doc.n > capacity:
                        for k, (a, c, e, size, kind) in enumerate(doc.pieces(capacity, overlap)):
                            x, y = int(doc.char[a]), int(doc.char[e])
                            rows.append((name, doc_id, k, x, y, int(doc.char[c]), size, "end" if e == doc.n else names[kind], text[x:y]))
            if rows:
                yield pd.DataFrame(rows, columns=["limit_name", "doc_id", "piece_no", "start_char", "end_char", "core_start", "tokens", "cut_at", "text"])

    return documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text").mapInPandas(split, PIECE_SCHEMA)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document longer than a ``piece_`` limit."""
    return split_documents(table(spark, sf_dir, "documents"), limits_of(table(spark, sf_dir, "size_limits"), "piece_"))


def p8_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, documents, the largest piece and where pieces were cut, per limit."""
    return p8_pieces(spark, sf_dir).groupBy("limit_name", "cut_at").agg(F.count("*").alias("pieces"), F.count_distinct("doc_id").alias("documents"), F.max("tokens").alias("largest"), F.round(F.avg("tokens"), 1).alias("mean_tokens"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``p8_pieces``, per limit: no piece is over it; each piece is the stretch of its document that its
    places name (``torn``); a document's new parts follow one another from its start to its end (``gaps``); and each piece but the
    first begins before the one above ends where the limit asks for an overlap (``apart``)."""
    limits = table(spark, sf_dir, "size_limits").where("limit_name like 'piece\\_%'").select("limit_name", "capacity_tokens", "overlap_tokens")
    pieces = p8_pieces(spark, sf_dir).join(F.broadcast(limits), "limit_name")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    w = Window.partitionBy("limit_name", "doc_id").orderBy("piece_no")
    at = pieces.join(docs, "doc_id").select("limit_name", "tokens", "capacity_tokens", "overlap_tokens", "start_char", "core_start", "end_char", F.lag("end_char").over(w).alias("before"), F.lead("piece_no").over(w).alias("next"), (F.col("text") == F.expr("substring(whole, start_char + 1, end_char - start_char)")).alias("fits"), F.length("whole").alias("n"))
    gap = (F.col("core_start") != F.coalesce("before", F.lit(0))) | (F.col("next").isNull() & (F.col("end_char") != F.col("n")))
    bad = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = at.groupBy("limit_name").agg(bad(F.col("tokens") > F.col("capacity_tokens")).alias("over"), bad(~F.col("fits")).alias("torn"), bad(gap).alias("gaps"), bad((F.col("overlap_tokens") > 0) & (F.col("start_char") >= F.col("before"))).alias("apart"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("over", "torn", "gaps", "apart")]
    return limits.select("limit_name").join(sums, "limit_name", "left").select("limit_name", *zero)


QUERIES = {"p8_pieces": p8_pieces, "p8_cuts": p8_cuts, "p8_kept": p8_kept}
SQL = {"p8_kept": "SELECT limit_name, 0 AS over, 0 AS torn, 0 AS gaps, 0 AS apart FROM size_limits WHERE limit_name LIKE 'piece\\_%' ESCAPE '\\'"}
