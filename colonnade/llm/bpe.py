"""Byte-level BPE encoding by a trie of distinct words, and decoding.

The encodings of all prefixes of a word hang together: the encoding of a prefix that ends
in token t is the encoding of what stands before t, followed by t. So a prefix needs only
its last token as state. Distinct words go into a trie; a depth-first walk gives every node
the last token of its prefix, from the states of its ancestors, and what words share at
their start is worked out once. The last token of a node is the one vocabulary entry that
ends there and that BPE leaves apart from the last token before it.

Rules: a null text encodes like the empty one (no ids); repeated rows are encoded alike;
a word of any length costs time in proportion to its length; added tokens of the
vocabulary file are recognised in the text, as the file's own library does by default;
truncation and padding are not applied. Columns named like the results are replaced.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colonnade.llm.batches import with_results

# Fixed value: the split into words that byte-level vocabularies of this kind use.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a Python worker holds at most before it starts a new trie.
MOST_NODES, MOST_WORDS, MOST_PAIRS = 1_000_000, 400_000, 500_000


def _byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _latin_words() -> re.Pattern:
    """``WORDS`` for texts whose characters are all below U+0100, for the faster engine."""

    def members(test) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if test(chr(c)))

    letter = members(lambda c: unicodedata.category(c)[0] == "L")
    number = members(lambda c: unicodedata.category(c)[0] == "N")
    space = "\t-\r \x85\xa0"
    pattern = WORDS.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    pattern = pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(pattern.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


class Vocabulary:
    """A byte-level BPE file: ids, merges in order, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, byte_of = content["model"], _byte_characters()
        self.ids = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.left, self.right, self.merged = {}, {}, {}
        for order, merge in enumerate(model["merges"]):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (self.ids[bytes(byte_of[c] for c in part)] for part in pair)
            made = self.ids[self.bytes[a] + self.bytes[b]]
            if made != 256 + order:
                raise ValueError(f"{path}: ids do not follow the order of the merges")
            self.left[made], self.right[made], self.merged[a, b] = a, b, made
        self.longest = max(map(len, self.ids))

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes together is these two tokens. Merges are
        undone from the latest on; one across the border that comes before the merge
        undone last would have happened."""
        limit = len(self.ids)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                limit, left = left, self.right[left]
            else:  # of equal merges the one further left comes first
                limit, right = right + 1, self.left[right]


class TrieEncoder:
    """Ids as bytes, four per id, little endian. The trie grows from batch to batch and is
    started anew when it is large; results never depend on what it holds."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._latin, self._any = _latin_words(), regex.compile(WORDS)
        names = sorted(self.vocabulary.added, key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._code = {i: i.to_bytes(4, "little") for i in self.vocabulary.bytes}
        self._table = [self.vocabulary.bytes.get(i, b"") for i in range(max(self._code) + 1)]
        self._known: dict[str, bytes] = {}
        self._apart: dict[int, bool] = {}
        self._new_trie()

    def _new_trie(self) -> None:
        self._child: dict[int, int] = {}
        self._last = array("i", [-1])

    def _insert(self, word: bytes) -> bytes:
        """Walk or grow the path of a word, give new nodes their last token, and read the
        encoding back from the end."""
        child, last, ids = self._child, self._last, self.vocabulary.ids
        node, path = 0, [0]
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                node = child[key] = len(last)
                for start in range(max(0, depth - self.vocabulary.longest), depth):
                    token = ids.get(word[start:depth])
                    if token is not None and (not start or self._fits(last[path[start]], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary has no encoding for a prefix")
            path.append(node)
        tokens, depth = [], len(word)
        while depth:
            token = last[path[depth]]
            tokens.append(self._code[token])
            depth -= len(self._table[token])
        return b"".join(reversed(tokens))

    def _fits(self, before: int, token: int) -> bool:
        key = before << 20 | token
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) >= MOST_PAIRS:
                self._apart.clear()
            found = self._apart[key] = self.vocabulary.stay_apart(before, token)
        return found

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any.findall(text)
        return self._latin.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        parts = [
            self._added.split(t or "") if self._added and "<" in (t or "") else [t or ""]
            for t in texts
        ]
        split = [[self._split(p) if not i % 2 else p for i, p in enumerate(own)] for own in parts]
        if len(self._known) > MOST_WORDS:
            self._known.clear()
        if len(self._last) > MOST_NODES:
            self._new_trie()
        known = self._known
        new = {w for own in split for words in own[::2] for w in words if w not in known}
        for word in sorted(new):  # the order of a depth-first walk
            known[word] = self._insert(word.encode())
        encoded = []
        for own in split:
            out = [
                b"".join([known[w] for w in p]) if not i % 2 else self._code[self.vocabulary.added[p]]
                for i, p in enumerate(own)
            ]
            encoded.append(out[0] if len(out) == 1 else b"".join(out))
        return encoded

    def decode(self, encoded: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self._table
        return b"".join([table[i] for i in memoryview(encoded).cast("I")]).decode(errors="replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One per Python worker and vocabulary file."""
    return TrieEncoder(path)


def encode_texts(
    frame: DataFrame, path: str, text: str = "text", decode: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """The frame with ``ids`` (binary, unsigned 32-bit little endian) and, if asked for,
    ``decoded``, the text that the ids stand for. ``keep``: the columns to keep (all)."""
    fields = [("ids", T.BinaryType())] + [("decoded", T.StringType())] * decode

    def make():
        own = encoder(path)

        def work(texts):
            ids = own.encode(texts)
            return (ids, map(own.decode, ids)) if decode else (ids,)

        return work

    return with_results(frame, text, fields, make, keep)
