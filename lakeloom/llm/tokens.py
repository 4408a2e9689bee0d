"""Token counts under public tokenizers, for use inside Arrow batches.

A vocabulary is read once on the driver and its bytes (under 1 MB, fixed by the tokenizer, not by the data) travel
with the function; executors need no file.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

TOKENIZER_DIR = os.environ.get("LAKELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(name: str = VOCABULARY, directory: str | None = None) -> bytes:
    with open(os.path.join(directory or TOKENIZER_DIR, name), "rb") as f:
        return f.read()


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


@lru_cache(maxsize=2)
def encoding(data: bytes):
    """The exact byte-pair encoder of a vocabulary, one per worker."""
    import tiktoken

    return tiktoken.Encoding("lakeloom", pat_str=PATTERN, mergeable_ranks=_ranks(data), special_tokens={})


class LongestMatch:
    """Longest-match-first tokenization of byte strings in linear time.

    A trie over the vocabulary; each node has a failure link and the number of tokens that are certain once no edge
    leads on, so every byte is consumed once and every link followed at most once per byte. The vocabulary must hold
    every byte that can occur, as byte-level vocabularies do.
    """

    _WORD = re.compile(rb" ?[^\s]+|\s+")
    MEMO, MEMO_BYTES = 200_000, 48

    def __init__(self, vocabulary: set[bytes]):
        edges: dict[int, int] = {}
        token = [False]
        parents = [(0, 0)]
        for word in vocabulary:
            node = 0
            for byte in word:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(token)
                    token.append(False)
                    parents.append((node, byte))
                node = edges[key]
            token[node] = True
        lacking = [b for b in range(256) if b not in edges or not token[edges[b]]]
        if lacking:
            raise ValueError(f"the vocabulary lacks {len(lacking)} single bytes")
        order = [0]
        for node in order:  # breadth first: a parent, and whatever is less deep, is done before its children
            if node == 0:
                children: list[list[int]] = [[] for _ in token]
                for child, (parent, _) in enumerate(parents):
                    if child:
                        children[parent].append(child)
            order.extend(children[node])
        fail, emitted = [0] * len(token), [0] * len(token)
        for node in order[1:]:
            if token[node]:
                fail[node], emitted[node] = 0, 1
                continue
            parent, byte = parents[node]
            count, at = emitted[parent], fail[parent]
            while (at << 8 | byte) not in edges:
                count += emitted[at]
                at = fail[at]
            fail[node], emitted[node] = edges[at << 8 | byte], count
        rest = [0] * len(token)
        for node in order[1:]:
            at, count = node, 0
            while at:
                count += emitted[at]
                at = fail[at]
            rest[node] = count
        self.edges, self.fail, self.emitted, self.rest, self.memo = edges, fail, emitted, rest, {}

    def count_word(self, word: bytes) -> int:
        edges, fail, emitted = self.edges, self.fail, self.emitted
        node = count = 0
        for byte in word:
            on = edges.get(node << 8 | byte)
            while on is None:
                count += emitted[node]
                node = fail[node]
                on = edges.get(node << 8 | byte)
            node = on
        return count + self.rest[node]

    def count(self, text: str | None) -> int:
        """Tokens of a text; none in a null or empty one. Words of one space and what follows it are tokenized apart."""
        if not text:
            return 0
        memo, total = self.memo, 0
        for word in self._WORD.findall(text.encode("utf-8", "replace")):
            n = memo.get(word)
            if n is None:
                n = self.count_word(word)
                if len(word) <= self.MEMO_BYTES:
                    if len(memo) >= self.MEMO:
                        memo.clear()
                    memo[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def longest_match(data: bytes) -> LongestMatch:
    return LongestMatch(set(_ranks(data)))
