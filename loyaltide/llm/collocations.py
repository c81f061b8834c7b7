"""Phrase collocations by weighted acyclic automata.

Each task turns the n-grams of a shard (some million words) into automata: sorted n-grams become a
tree whose arcs carry the number of n-grams through them, and states with the same continuations are
merged, last ones first.  Every range of prefixes has an automaton of its own, so the automata of all
shards for one range meet in one group: they are united, weights summed, and every arc of weight 30
or more is a phrase with its count.  A range is a slice of the hash of language and first words: two
words for the pairs, three for the longer phrases, so a frequent word or pair is spread over ranges.

A phrase is no more frequent than its parts.  So words are counted first, pairs only of words that
occur often enough, longer n-grams only along such pairs.  What tasks know of that are bitmaps of
fixed size, which may let more pass and never less.

Counts of parts: phrases with the same first two words meet in a range again, as an automaton whose
arcs carry counts; composed with the phrases it yields the counts of all their beginnings.  The same
backwards yields the counts of their ends.  Words and languages are told apart by 64-bit hashes.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.llm.common import give_back, text_batches
from loyaltide.staging import stage

LONGEST = 4
SHARD_WORDS = 800_000          # words of a shard
UNION_ARCS = 400_000           # arcs united at a time
RANGE_WORDS = 6_000_000        # words whose n-grams one range holds on average
RANGE_PHRASES = 100_000        # phrases composed together on average
DISTINCT = 250_000             # different words counted at a time
BITS = 24                      # a bitmap has 2 ** BITS places
BUCKETS = 64                   # parts of a language in which the foremost phrases are found first
UNKNOWN = "und"

_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_NONE = -1


def _label(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2 ** 63


def _lower(text: str | None) -> bytes:
    """The text with A-Z lower-cased and each end of a piece a line end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PIECES)


def _pieces(text: str | None) -> list[list[bytes]]:
    """Words of each piece of a text."""
    return [words for words in map(bytes.split, _lower(text).split(b"\n")) if words]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...``, ``counts[k]`` numbers each, one after the other."""
    offset = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + np.arange(len(offset)) - offset


def _sorted_rows(paths: list[np.ndarray], width: int) -> np.ndarray:
    """The order of rows of numbers from -1 to ``width - 2``; several places are sorted as one."""
    keys, room = [], 0
    for place in paths:
        if room < width:
            keys.append(place + 1)
            room = 2 ** 62 // width
        else:
            keys[-1] = keys[-1] * width + (place + 1)
            room //= width
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


def _smallest(a: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the smallest type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 2 ** 8 else np.uint16 if top < 2 ** 16
                    else np.uint32 if top < 2 ** 32 else np.uint64)


class Automaton:
    """Sequences of symbols with weights: the weight of a sequence is that of its last arc.

    ``symbols`` are the 64-bit labels in use.  Depth by depth, ``degree`` holds the number of arcs of
    each state, and ``symbol`` (position in ``symbols``), ``weight`` and ``target`` (state one level
    deeper) one entry per arc, sorted by state and symbol.
    """

    def __init__(self, symbols: np.ndarray, levels: list[tuple[np.ndarray, ...]]):
        self.symbols, self.levels = symbols, levels

    @classmethod
    def of(cls, paths: list[np.ndarray], weights: np.ndarray, summed: bool = True) -> Automaton:
        """Automaton of sequences given as positions, one array per place (``_NONE`` after the end).

        ``summed``: an arc weighs what all sequences through it weigh; otherwise what the sequence
        that ends with it weighs (0 if there is none).
        """
        width = max((int(p.max()) + 1 for p in paths if len(p)), default=1)
        order = _sorted_rows(paths, width + 1)
        weights = weights[order]
        upto = np.r_[0, np.cumsum(weights)]
        new = np.arange(len(order)) == 0
        state = np.zeros(len(order), np.int64)
        arcs = []
        for depth, place in enumerate(paths):
            place = place[order]
            new[1:] |= place[1:] != place[:-1]              # another sequence up to here
            begins = np.flatnonzero(new)
            held = place[begins] != _NONE
            first = begins[held]
            if summed:
                weight = upto[np.r_[begins[1:], len(order)][held]] - upto[first]
            else:                                           # sequences that end come first
                ends = (paths[depth + 1][order[first]] == _NONE if depth + 1 < len(paths)
                        else np.full(len(first), True))
                weight = np.where(ends, weights[first], 0)
            arcs.append((state[first], place[first], weight))
            mark = np.zeros(len(order), np.int64)
            mark[first] = 1
            state = np.cumsum(mark) - 1
        return cls(np.arange(width), _merged(arcs))

    @property
    def arcs(self) -> int:
        return sum(len(symbol) for _, symbol, _, _ in self.levels)

    def with_symbols(self, symbols: np.ndarray) -> Automaton:
        """The same automaton with labels for its positions; labels without an arc are dropped."""
        used = np.zeros(len(symbols), bool)
        for _, symbol, _, _ in self.levels:
            used[symbol] = True
        new = np.cumsum(used) - 1
        return Automaton(symbols[used], [(d, new[s], w, t) for d, s, w, t in self.levels])

    def sequences(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All sequences as labels (0 after the end) and what ends there of the summed weights."""
        paths, ends, before = [], [], []
        state, path = np.zeros(1, np.int64), []
        for degree, symbol, weight, target in self.levels:
            degree = degree.astype(np.int64)
            first = np.cumsum(degree) - degree
            many = degree[state]
            arc = _spread(first[state], many)
            if path:                                       # what goes on does not end here
                own = np.repeat(np.arange(len(state)), many)
                ends[-1] = before[-1] - np.bincount(own, weight[arc], len(state)).astype(np.int64)
            path = [np.repeat(p, many) for p in path] + [self.symbols[symbol[arc].astype(np.int64)]]
            before.append(weight[arc].astype(np.int64))
            ends.append(before[-1])
            paths.append(path)
            state = target[arc].astype(np.int64)
        out = []
        for place in range(len(self.levels)):
            out.append(np.concatenate([p[place][e > 0] if place < len(p)
                                       else np.zeros((e > 0).sum(), np.int64)
                                       for p, e in zip(paths, ends, strict=True)]))
        return out, np.concatenate([e[e > 0] for e in ends])

    def along(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Composition with sequences of labels: the weight of each of their beginnings, by length."""
        out, state = [], np.zeros(len(paths[0]), np.int64)
        order = np.argsort(self.symbols)
        for (degree, symbol, weight, target), place in zip(self.levels, paths, strict=True):
            at = np.searchsorted(self.symbols, place, sorter=order)
            symbol_of = order[np.minimum(at, len(order) - 1)]
            known = (self.symbols[symbol_of] == place) & (state >= 0)
            width = len(self.symbols)
            keys = np.repeat(np.arange(len(degree)), degree) * width + symbol
            wanted = state * width + symbol_of
            arc = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            if len(keys):
                known &= keys[arc] == wanted
                out.append(np.where(known, weight[arc], 0))
                state = np.where(known, target[arc], -1)
            else:
                out.append(np.zeros(len(place), np.int64))
        return out

    def pack(self) -> bytes:
        arrays = [self.symbols, *(_smallest(a) for level in self.levels for a in level)]
        head = b"".join(struct.pack("<cQ", a.dtype.char.encode(), len(a)) for a in arrays)
        body = b"".join(a.tobytes() for a in arrays)
        return zstandard.compress(struct.pack("<I", len(arrays)) + head + body, 1)

    @classmethod
    def unpack(cls, data: bytes) -> Automaton:
        data = zstandard.decompress(data)
        count, = struct.unpack_from("<I", data)
        at, arrays = 4 + 9 * count, []
        for i in range(count):
            kind, size = struct.unpack_from("<cQ", data, 4 + 9 * i)
            arrays.append(np.frombuffer(data, np.dtype(kind.decode()), size, at))
            at += arrays[-1].nbytes
        return cls(arrays[0], [tuple(arrays[i:i + 4]) for i in range(1, count, 4)])


def _merged(arcs: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Levels of the automaton of a tree (state, symbol, weight per arc): equal states are one."""
    levels = []
    target = np.zeros(len(arcs[-1][0]), np.int64)           # the last arcs lead to one final state
    for depth in range(len(arcs) - 1, -1, -1):
        state, symbol, weight = arcs[depth]
        states = len(arcs[depth - 1][0]) if depth else 1
        degree = np.bincount(state, minlength=states)
        if depth:
            first = np.cumsum(degree) - degree
            mark = np.zeros((states, 2), np.uint64)
            filled = degree > 0
            for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                x = _mixed(symbol.astype(np.uint64) * np.uint64(factor) + np.uint64(k))
                x = _mixed((x ^ weight.astype(np.uint64)) * np.uint64(factor))
                x = _mixed((x + target.astype(np.uint64)) * np.uint64(factor))
                if len(x):
                    mark[filled, k] = np.add.reduceat(x, first[filled])
            order = np.lexsort((mark[:, 1], mark[:, 0]))
            new = np.r_[True, (mark[order[1:]] != mark[order[:-1]]).any(axis=1)][:states]
            name = np.empty(states, np.int64)
            name[order] = np.cumsum(new) - 1
            kept = order[new]
            arc = _spread(first[kept], degree[kept])
            levels.append((degree[kept], symbol[arc], weight[arc], target[arc]))
            target = name
        else:
            levels.append((degree, symbol, weight, target))
    return levels[::-1]


def unite(automata: list[Automaton]) -> Automaton:
    """The union of automata with summed weights."""
    parts = [a.sequences() for a in automata]
    paths = [np.concatenate([p[i] for p, _ in parts]) for i in range(len(parts[0][0]))]
    weights = np.concatenate([w for _, w in parts])
    del parts
    symbols = np.unique(np.concatenate(paths))
    for i, path in enumerate(paths):
        paths[i] = np.where(path == 0, _NONE, np.searchsorted(symbols, path))
    return Automaton.of(paths, weights).with_symbols(symbols)


def unite_packed(packed: list[bytes]) -> Automaton:
    """The union of packed automata, some at a time: what is in hand besides the union so far stays
    below it in size, or below ``UNION_ARCS``."""
    whole, waiting, arcs = None, [], 0
    for data in packed:
        waiting.append(Automaton.unpack(data))
        arcs += waiting[-1].arcs
        if arcs > max(UNION_ARCS, whole.arcs // 2 if whole else 0):
            whole = unite([whole, *waiting] if whole else waiting)
            waiting, arcs = [], 0
    return unite([whole, *waiting] if whole else waiting) if waiting else whole


# -- words -------------------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, lang_key, word, label, f`` of ``lang, text``; the row without a word has the total."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}

        def rows():
            for lang, of in counts.items():
                total = sum(of.values())
                texts = [w.decode("utf-8", "surrogatepass") for w in of]
                yield pd.DataFrame({"lang": lang, "lang_key": _label(lang.encode()),
                                    "word": [*texts, None], "label": [*map(_label, of), 0],
                                    "f": [*of.values(), total]})
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                counts.setdefault(lang, Counter()).update(_lower(text).split())
                if sum(map(len, counts.values())) > DISTINCT:
                    yield from rows()
        yield from rows()
        give_back()

    partial = docs.mapInPandas(
        run, "lang string, lang_key bigint, word string, label bigint, f bigint")
    return partial.groupBy("lang", "lang_key", "word", "label").agg(F.sum("f").alias("f"))


def _bitmap(marks: DataFrame) -> np.ndarray:
    """The places ``mark`` as bits: at most ``2 ** (BITS - 6)`` rows come to the driver."""
    rows = (marks.select(F.expr(f"mark & {2 ** BITS - 1}L").alias("p"))
            .groupBy(F.shiftright("p", 6).alias("at"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("bits")).toPandas())
    out = np.zeros(2 ** (BITS - 6), np.uint64)
    out[rows["at"].to_numpy().astype(np.int64)] = (
        rows["bits"].to_numpy().astype(np.int64).view(np.uint64))
    return out.view(np.uint8)


def _marked(bitmap: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks.astype(np.uint64) & np.uint64(2 ** BITS - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _key(*labels: np.ndarray) -> np.ndarray:
    """Hash of languages and first words."""
    key = np.zeros(len(labels[0]), np.uint64)
    for label in labels:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + label.view(np.uint64))
    return key


# -- n-grams -----------------------------------------------------------------------------------------

class Codes(dict):
    """Numbers of words, given when a word is first met."""

    def __init__(self, new: Callable[[bytes], int]):
        super().__init__()
        self.new = new

    def __missing__(self, word: bytes) -> int:
        code = self[word] = self.new(word)
        return code


class Shard:
    """Words of some documents, and their n-grams as one automaton per range: pairs of frequent
    words, or with a bitmap of frequent pairs the longer n-grams made of those."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray | None, ranges: int):
        self.words, self.pairs, self.ranges = words, pairs, ranges
        self.clear()

    def clear(self) -> None:
        self.code_of = Codes(self._new)
        self.labels: list[int] = []
        self.codes: list[int] = []
        self.size = 0

    def _new(self, word: bytes) -> int:
        label = _label(word)
        at = label & (2 ** BITS - 1)
        if not self.words[at >> 3] >> (at & 7) & 1:
            return _NONE
        self.labels.append(label)
        return len(self.labels) - 1

    def add(self, lang: int, text: str | None) -> None:
        """Append a document: each piece starts with its language, which is a gap between words."""
        for words in _pieces(text):
            self.codes.append(-2 - lang)
            self.codes.extend(map(self.code_of.__getitem__, words))
            self.size += len(words)

    def automata(self, langs: list[int]) -> Iterator[tuple[int, bytes]]:
        """``(range, packed automaton)``; ``langs`` are the labels of the languages."""
        self.codes += [_NONE] * LONGEST
        code = np.array(self.codes, np.int32)
        self.codes = []
        start = np.flatnonzero(code < _NONE)
        if not len(start):
            return
        label = np.array([*self.labels, *langs], np.int64)
        lang = np.repeat(np.int32(len(self.labels) - 2) - code[start],
                         np.diff(np.r_[start, len(code)]))
        code[start] = _NONE
        at = np.flatnonzero((code[:-1] != _NONE) & (code[1:] != _NONE))
        key = _key(label[lang[at]], label[code[at]], label[code[at + 1]])
        if self.pairs is None:
            place = [lang[at], code[at], code[at + 1]]
        else:
            ok = np.zeros(len(code), bool)
            ok[at] = _marked(self.pairs, key)
            at = np.flatnonzero(ok[:-1] & ok[1:])
            place = [lang[at], code[at], code[at + 1], code[at + 2],
                     np.where(ok[at + 2], code[np.minimum(at + 3, len(code) - 1)], _NONE)]
            key = _key(*[label[p] for p in place[:4]])
        range_ = ((key >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(range_, kind="stable")
        bounds = np.searchsorted(range_[order], np.arange(self.ranges + 1))
        for r in np.flatnonzero(np.diff(bounds)):
            rows = order[bounds[r]:bounds[r + 1]]
            used = np.zeros(len(label) + 1, bool)           # the last one stands for no word
            for p in place:
                used[p[rows]] = True
            used[_NONE] = False
            local = np.cumsum(used) - 1
            local[_NONE] = _NONE
            yield int(r), (Automaton.of([local[p[rows]] for p in place],
                                        np.ones(len(rows), np.int64))
                           .with_symbols(label[used[:-1]]).pack())


def shard_automata(docs: DataFrame, words: np.ndarray, pairs: np.ndarray | None,
                   ranges: int) -> DataFrame:
    """``range, automaton`` of the n-grams of ``lang, text``, one per shard and range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, langs = Shard(words, pairs, ranges), {}

        def rows():
            found = list(shard.automata([_label(x.encode()) for x in langs]))
            shard.clear()
            langs.clear()
            return pd.DataFrame(found, columns=["range", "automaton"]).astype({"range": "int32"})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                shard.add(langs.setdefault(lang, len(langs)), text)
                if shard.size > SHARD_WORDS:
                    yield rows()
        yield rows()
        give_back()

    return docs.mapInPandas(run, "range int, automaton binary")


def phrase_counts(automata: DataFrame, least: int, shortest: int) -> DataFrame:
    """``lang_key, words, f, mark``: phrases of ``shortest`` words or more with at least ``least``
    occurrences; ``mark`` is the place of a phrase's first two words in a bitmap."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = unite_packed(pdf["automaton"].tolist())
        parts, state, path = [], np.zeros(1, np.int64), []
        for depth, (degree, symbol, weight, target) in enumerate(whole.levels):
            first = np.cumsum(degree) - degree
            many = degree[state]
            arc = _spread(first[state], many)
            path = [np.repeat(p, many) for p in path] + [whole.symbols[symbol[arc]]]
            state = target[arc]
            if depth < shortest:
                continue
            keep = weight[arc] >= least                     # longer ones are no more frequent
            path, state = [p[keep] for p in path], state[keep]
            mark = (_key(*path[:3]) & np.uint64(2 ** BITS - 1)).astype(np.int64)
            parts.append(pd.DataFrame({"lang_key": path[0], "words": list(np.stack(path[1:], 1)),
                                       "f": weight[arc][keep], "mark": mark}))
        del whole
        give_back()
        return pd.concat(parts)

    return automata.groupBy("range").applyInPandas(
        run, "lang_key bigint, words array<bigint>, f bigint, mark bigint")


# -- parts -------------------------------------------------------------------------------------------

def part_counts(phrases: DataFrame, name: str, backwards: bool = False) -> DataFrame:
    """``phrases`` with the counts of their beginnings (ends) of 2, 3, ... words as ``name``."""
    ranges = max(1, -(-phrases.count() // RANGE_PHRASES))
    first = F.expr("slice(reverse(words), 1, 2)" if backwards else "slice(words, 1, 2)")
    others = [c for c in phrases.columns if c not in ("lang_key", "words", "f")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [w[::-1] if backwards else w for w in pdf["words"]]
        length = np.array([len(w) for w in words])
        table = np.zeros((len(words), LONGEST), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            table[rows, :n] = np.stack([words[i] for i in rows])
        labels = [pdf["lang_key"].to_numpy(), *table.T]
        symbols = np.unique(np.concatenate(labels))
        places = [np.searchsorted(symbols, x) for x in labels]
        for n in range(LONGEST):
            places[n + 1] = np.where(n < length, places[n + 1], _NONE)
        counts = Automaton.of(places, pdf["f"].to_numpy(), summed=False).with_symbols(symbols)
        found = np.stack(counts.along(labels), axis=1)[:, 2:]
        return pdf[["lang_key", "words", "f", *others]].assign(
            **{name: [row[:n - 1] for row, n in zip(found, length, strict=True)]})

    keyed = phrases.withColumn("range", F.pmod(F.xxhash64("lang_key", first), F.lit(ranges)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in phrases.schema)
    return keyed.groupBy("range").applyInPandas(run, f"{schema}, {name} array<bigint>")


def mine(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80,
         lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language.

    Words are lower-cased (A-Z) and stand between blanks and tabs in pieces that end at punctuation
    and line ends.  ``a`` occurrences of a phrase of 2 to 4 words, ``l`` of its first and ``r`` of
    its other part at the cut where ``score = floor(2000000 a / (l + r))`` is lowest (ties: first
    cut), ``n`` words of the language in all.  A phrase inside a longer one that has at least
    ``inside`` percent of its occurrences is left out.

    Null languages are ``und``; null, empty and blank texts have no words; repeated rows count each;
    a text may be of any length; an empty table, or one without phrases that often, gives an empty
    result; other columns are not read.  All occurrences in all texts are counted; ``top`` only ends
    the report.
    """
    rows = text_batches(docs).select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"),
                                     F.col(text_col).alias("text"))
    words = stage(word_counts(rows).filter(F.col("word").isNull() | (F.col("f") >= least)),
                  "collocation-words")
    totals = words.filter(F.col("word").isNull()).select("lang", "lang_key", F.col("f").alias("n"))
    words = words.filter(F.col("word").isNotNull())
    ranges = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS))
    often = _bitmap(words.select(F.col("label").alias("mark")))
    pairs = stage(phrase_counts(shard_automata(rows, often, None, ranges), least, 2),
                  "collocation-pairs")
    longer = phrase_counts(shard_automata(rows, often, _bitmap(pairs), ranges), least, 3)
    phrases = stage(pairs.unionByName(longer).drop("mark"), "collocation-phrases")

    around = (phrases.filter(F.size("words") > 2).select("lang_key", F.col("f").alias("longest"),
              F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform("
                               "sequence(1, size(words) - k + 1), i -> slice(words, i, k))))"))
              .alias("words"))
              .groupBy("lang_key", "words").agg(F.max("longest").alias("longest")))
    begun = part_counts(phrases, "begins")
    parts = part_counts(begun, "ends", backwards=True).join(around, ["lang_key", "words"], "left")
    alone = parts.filter(F.expr("longest IS NULL OR CAST(longest AS DECIMAL(20, 0)) * 100 < "
                                f"CAST(f AS DECIMAL(20, 0)) * {inside}"))
    single = words.select("lang_key", "label", "f")
    counted = (alone.withColumn("label", F.col("words")[0])
               .join(single.withColumnRenamed("f", "head"), ["lang_key", "label"])
               .withColumn("label", F.element_at("words", -1))
               .join(single.withColumnRenamed("f", "tail"), ["lang_key", "label"]))
    # begins[i] counts the first i + 2 words, ends[i] the last i + 2.
    best = F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> transform(array(
          named_struct('l', IF(k = 1, head, begins[k - 2]),
                       'r', IF(k = size(words) - 1, tail, ends[size(words) - k - 2]))),
          p -> named_struct('score', (CAST(f AS DECIMAL(20, 0)) * 2000000)
                                     DIV (CAST(p.l AS DECIMAL(20, 0)) + p.r),
                            'cut', k, 'l', p.l, 'r', p.r))[0]))""")
    scored = counted.withColumn("best", best).select(
        "lang_key", "words", F.col("f").alias("a"), "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a")]
    foremost = scored.withColumn("bucket", F.pmod(F.xxhash64("words"), F.lit(BUCKETS)))
    for group in (["lang_key", "bucket"], ["lang_key"]):    # with ties, which the words decide
        place = F.rank().over(Window.partitionBy(*group).orderBy(*order))
        foremost = foremost.withColumn("place", place).filter(F.col("place") <= top)
    spelt = (foremost.select("*", F.posexplode("words").alias("at", "label"))
             .join(words.select("lang_key", "label", "word"), ["lang_key", "label"])
             .groupBy("lang_key", "words", "a", "l", "r", "score")
             .agg(F.expr("array_join(transform(array_sort(collect_list(struct(at, word))), "
                         "x -> x.word), ' ')").alias("phrase")))
    by_lang = Window.partitionBy("lang").orderBy(*order, F.asc("phrase"))
    return (spelt.join(totals, "lang_key")
            .withColumn("rank", F.row_number().over(by_lang)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
                    "n", F.col("score").cast("bigint").alias("score")))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The same report in DuckDB, every phrase of every piece counted.
SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, f AS a, ws, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
                JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT x.lang, x.part AS phrase FROM (
        SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2),
          lambda j: array_to_string(ws[j:j + m - 1], ' '))))) AS part FROM c WHERE k > 2) x
      JOIN c ON c.lang = x.lang AND c.phrase = x.part WHERE 100 * x.f >= 80 * c.f)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase,
  a, l, r, n, CAST(score AS BIGINT) AS score
FROM b JOIN n ON n.lang = b.lang ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase QUALIFY rank <= 2000
"""
