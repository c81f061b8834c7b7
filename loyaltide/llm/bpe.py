"""BPE encoding and decoding by prefix-sharing trie traversal.

The merge rules make the encoding of a text unique, and two tokens may follow one another only if
merging their concatenation from scratch gives the two back.  Hence the last token of every prefix
of a word determines the whole encoding: drop that token, look at the last token of the shorter
prefix, and so on.  Distinct words go into a trie over initial symbols; a depth-first walk gives
each node the last token of its prefix, found among the tokens that end there (longest first) by
the pair rule against the last token of the prefix before it.  Words with common beginnings share
nodes, so a shared prefix is encoded once.

Documents are cut into words inside each task; a word is encoded the first time a task meets it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyaltide.llm.common import give_back, text_batches

LATER = re.compile("[\u0500-\u1fff\u2070-\U0010ffff]")   # where new letters may be
END = 0x10000                  # added to the last character of a word
CACHED_PAIRS = 100_000
CACHED_WORDS = 250_000         # encodings a task keeps (about 60 MB); beyond, those of the last batch


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else 256, 257, ..."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def without_new_letters(pattern: str) -> str:
    """The pattern with letters and digits as Python's own character table knows them.

    The regex package may know characters of a later Unicode version than the tokenizers library.
    """
    new = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
    known = regex.compile(r"[\p{L}\p{N}]")
    ranges: list[list[int]] = []
    for c in filter(known.match, new):
        if ranges and ord(c) == ranges[-1][1] + 1:
            ranges[-1][1] += 1
        else:
            ranges.append([ord(c), ord(c)])
    if not ranges:
        return pattern
    late = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return "(?V1)" + (pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{late}])")
                      .replace(r"[\p{L}]", rf"[\p{{L}}--[{late}]]")
                      .replace(r"[\p{N}]", rf"[\p{{N}}--[{late}]]"))


class Tokenizer:
    """A word-level BPE vocabulary: lower-cased words with an end-of-word suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.split_any = regex.compile(without_new_letters(pattern))      # right but slower
        self.cut = (regex.compile("|".join(map(regex.escape, sorted(self.special, key=len,
                                                                    reverse=True))))
                    if self.special else None)
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        # Written forms: one character per initial symbol, so prefixes and suffixes are slices.
        # A symbol that carries the end-of-word suffix is its character moved up by ``END``.
        self.written = {t: self.write(t) for t in self.ids}
        # Only tokens that the merges make of their own symbols can end a prefix.
        self._build([(w, t) for t, w in self.written.items() if self.merged(w) == [t]])
        self._follows: dict[tuple[str, str], bool] = {}

    def _build(self, tokens: list[tuple[str, str]]) -> None:
        """Automaton over written forms: per state its children, where to go on when none fits
        (the longest proper suffix that is a state), and the tokens that end there, longest first."""
        self.below: list[dict[str, int]] = [{}]
        self.shorter, self.ending = [0], [()]
        for text, token in tokens:
            state = 0
            for c in text:
                if c not in self.below[state]:
                    self.below[state][c] = len(self.below)
                    self.below.append({})
                    self.shorter.append(0)
                    self.ending.append(())
                state = self.below[state][c]
            self.ending[state] = ((token, len(text)),)
        level = list(self.below[0].values())
        while level:                                      # breadth first: suffixes are shorter
            following = []
            for state in level:
                self.ending[state] += self.ending[self.shorter[state]]
                for c, child in self.below[state].items():
                    s = self.shorter[state]
                    while s and c not in self.below[s]:
                        s = self.shorter[s]
                    self.shorter[child] = self.below[s].get(c, 0)
                    following.append(child)
            level = following

    # -- words ---------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Words of a stretch without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if LATER.search(text):
                return self.split_any.findall(text.lower())
        return self.split.findall(text.lower())

    def stretches(self, text: str) -> Iterator[tuple[str, int | None]]:
        """``(text, None)`` for ordinary stretches, ``(token, id)`` for special tokens."""
        at = 0
        if self.cut and "<|" in text:
            for m in self.cut.finditer(text):
                yield text[at:m.start()], None
                yield m[0], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def write(self, token: str) -> str:
        """The written form of a token."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[:-len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + END)
        return token

    def write_word(self, word: str) -> str:
        body = word.encode("utf-8").decode("latin-1").translate(self.symbols)
        return body[:-1] + chr(ord(body[-1]) + END)

    # -- merging -------------------------------------------------------------------------------

    def merged(self, written: str) -> list[str]:
        """Apply the merge rules, lowest rank first; used on single tokens and pairs of tokens."""
        parts = [chr(ord(c) - END) + self.suffix if ord(c) >= END else c for c in written]
        rank, none = self.rank, len(self.rank)
        while len(parts) > 1:
            ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging the text of both tokens from scratch gives these two."""
        key = (a, b)
        known = self._follows.get(key)
        if known is None:
            known = self.merged(self.written[a] + self.written[b]) == [a, b]
            if len(self._follows) > CACHED_PAIRS:
                self._follows.clear()
            self._follows[key] = known
        return known

    # -- trie ----------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers."""
        trie: dict[str, dict] = {}
        for word in words:                # a node: children by symbol; "" leads to the word
            node = trie
            for s in self.write_word(word):
                below = node.get(s)
                if below is None:
                    below = node[s] = {}
                node = below
            node[""] = word
        out: dict[str, bytes] = {}
        below_of, shorter, ending, ids = self.below, self.shorter, self.ending, self.ids
        follows = self._follows
        last: list[str] = []              # last token of every prefix on the way, by length
        back: list[int] = []              # number of its symbols
        states = [0]                      # state of the automaton, by length
        stack = [(node, s, 1) for s, node in trie.items()]
        while stack:
            node, symbol, n = stack.pop()
            del last[n - 1:], back[n - 1:], states[n:]
            state = states[-1]
            reached = below_of[state].get(symbol)
            while reached is None and state:
                state = shorter[state]
                reached = below_of[state].get(symbol)
            states.append(reached or 0)
            for token, k in ending[reached or 0]:
                if k == n:
                    break
                before = last[n - k - 1]
                known = follows.get((before, token))
                if known or (known is None and self.may_follow(before, token)):
                    break
            else:
                raise ValueError(f"{symbol!r} is not in the vocabulary")
            last.append(token)
            back.append(k)
            for s, below in node.items():
                if s:
                    stack.append((below, s, n + 1))
                else:
                    found, i = [], n
                    while i:
                        found.append(ids[last[i - 1]])
                        i -= back[i - 1]
                    found.reverse()
                    out[below] = pack(f"<{len(found)}I", *found)
        return out

    # -- texts ---------------------------------------------------------------------------------

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text; ``cache`` holds words encoded before and is bounded."""
        cut = [[(self.words(t), i) for t, i in self.stretches(text)] for text in texts]
        seen: set[str] = set()
        for parts in cut:
            for words, i in parts:
                if i is None:
                    seen.update(words)
        if len(cache) + len(seen) > CACHED_WORDS:          # go on with the words of this batch
            kept = {w: cache[w] for w in seen & cache.keys()}
            cache.clear()
            cache.update(kept)
        cache.update(self.encode_words(sorted(seen - cache.keys())))
        get = cache.__getitem__
        return [b"".join([b"".join(map(get, words)) if i is None else pack("<I", i)
                          for words, i in parts]) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks: the vocabulary names no decoder."""
        get = self.tokens.__getitem__
        return " ".join(map(get, ids.tolist()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           batch_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, ids (binary: little-endian unsigned 32-bit), decoded`` for every row.

    Null texts count as empty and have no ids; repeated rows are encoded each; texts may be of any
    length; an empty table gives an empty result; other columns are not read.  ``path`` is the
    vocabulary's file, present on every machine; a task loads it and lets go of it at its end.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, cache = Tokenizer(path), {}
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            at = 0
            while at < len(texts):                       # bounded memory with long texts
                to, size = at, 0
                while to < len(texts) and (to == at or size < batch_bytes):
                    size += len(texts[to])
                    to += 1
                ids = tokenizer.encode(texts[at:to], cache)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[at:to].array, "ids": ids,
                    "decoded": [tokenizer.decode(np.frombuffer(x, "<u4")) for x in ids]})
                at = to
        del tokenizer, cache
        give_back()

    return (text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, f"doc_id {id_type}, ids binary, decoded string"))


def encode_report(docs: DataFrame, path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    coded = encode(docs, path, id_col, text_col)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
