"""Token counts at every prefix of a text.

Byte-pair encoding has this property: the encoding of a string ends in one token, and dropping that token leaves the
encoding of a shorter prefix. So for each prefix one number, its last token, fixes its whole encoding, and the count at
a prefix is one more than the count where its last token starts. The last token of a prefix is the one vocabulary entry
that ends there and that may stand behind the last token of the prefix before it; two tokens may stand side by side if
merging their joined bytes gives the two back. One left-to-right pass over a pretoken yields the exact count of every
prefix; texts are pretokens side by side, so counts of whole texts and of all their prefixes are sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm._shared import fresh, mapped, named, ship

#: Fixed value: the pattern that splits text before merges, as the tokenizer's byte-level splitter has it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEPT_WORDS = 300_000  # pretokens remembered by a worker; memory only, results do not depend on it
KEPT_LENGTH = 48


def _byte_letters() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies spell it with: printable bytes are themselves, the others
    follow from code point 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Maps a pretoken to its token count; ``prefixes`` gives the count at each byte prefix."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = {w: bytes(letters[c] for c in w) for w in spec["model"]["vocab"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids = {t: i for i, t in enumerate(raw.values())}
        ids = self.ids
        self.rank = {(ids[raw[a]], ids[raw[b]]): i for i, (a, b) in enumerate(pairs)}
        self.split_at = {ids[raw[a] + raw[b]]: (ids[raw[a]], ids[raw[b]], i) for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.longest = max(map(len, ids))
        self.names = list(ids)
        self.old: dict[str, int] = {}
        self.whole: dict[int, bool] = {}
        self.beside: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split = regex.compile(SPLIT)
        self.blank = regex.compile(r"\s*")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """Plain merging, lowest rank first; run once for a vocabulary entry, to see whether merging can reach it."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((r, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.rank.get(pair)) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.ids[self.names[parts[i]] + self.names[parts[i + 1]]]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge (0: left, 1: right) while ``token`` is merged together, each with the rank
        of the merge that swallows it."""
        if (out := self.edges.get((token, side))) is None:
            out, t, until = [], token, float("inf")
            while True:
                out.append((t, until))
                if t not in self.split_at:
                    break
                until, t = self.split_at[t][2], self.split_at[t][side]
            self.edges[token, side] = out
        return out

    def may_stand(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two back: no merge across their border comes before
        those that swallow its two sides; of equal merges the leftmost comes first."""
        rank = self.rank
        for x, x_until in self.edge(a, 1):
            for y, y_until in self.edge(b, 0):
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def prefixes(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ..., word."""
        n = len(word)
        counts, last = [0] * (n + 1), [0] * (n + 1)
        get, beside, whole, longest = self.ids.get, self.beside, self.whole, self.longest
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                t = get(word[start:end])
                if t is None:
                    continue
                if start:
                    key = last[start] << 20 | t
                    fits = beside.get(key)
                    if fits is None:
                        if len(beside) > 4 * KEPT_WORDS:
                            beside.clear()
                        fits = beside[key] = self.may_stand(last[start], t)
                else:
                    fits = whole.get(t)
                    if fits is None:
                        fits = whole[t] = self.merged(word[:end]) == [t]
                if fits:
                    counts[end], last[end] = counts[start] + 1, t
                    break
            else:
                raise ValueError(f"no token ends prefix {word[:end]!r}: the vocabulary lacks a byte")
        return counts

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.prefixes(word.encode("utf-8", "surrogatepass"))[-1]
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:  # words met since the last time stay known
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n

    def pieces(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Stretches of text between special strings, and the special strings."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        yield at, len(text), False

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return sum(1 if special else self.plain(text[a:b]) for a, b, special in self.pieces(text))

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split.findall(text)))

    def at_every_prefix(self, text: str) -> np.ndarray:
        """Token count of text[:i] encoded on its own, for each i from 0 to len(text)."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        done = began = start = 0
        for a, b, special in self.pieces(text):
            if special:  # until its last character it is ordinary text behind the stretch before it
                for i in range(a + 1, b):
                    out[i] = began + self.plain(text[start:i])
                done += 1
                out[b] = done
                continue
            began, start = done, a
            run = None  # where the white space that reaches up to here starts, and the count before it
            for m in self.split.finditer(text[a:b]):
                s, e, word = a + m.start(), a + m.end(), m.group()
                out[s + 1 : e + 1] = done + self._by_letter(word)
                lead = self.blank.match(word).end()
                if lead:  # a prefix that ends in white space has all of that run as its last pretoken
                    first, before = run or (s, done)
                    out[s + 1 : s + lead + 1] = before + self._by_letter(text[first : s + lead])[s - first :]
                    run = (first, before) if lead == len(word) else None
                else:
                    run = None
                if word in ("'re", "'ve", "'ll"):  # unfinished, it is a quote and a letter
                    out[s + 2] = done + self["'"] + self[word[1]]
                done += self[word]
                out[e] = done if lead < len(word) else out[e]
        return out

    def _by_letter(self, word: str) -> np.ndarray:
        sizes = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])
        return np.array(self.prefixes(word.encode("utf-8", "surrogatepass")))[sizes]


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def fit(c: PrefixCounter, text: str, budget: int) -> int:
    """Characters of the longest prefix that ends at a pretoken's inside or end and has at most ``budget`` tokens."""
    done = 0
    for a, b, special in c.pieces(text):
        if special:
            if done + 1 > budget:
                return a
            done += 1
            continue
        for m in c.split.finditer(text, a, b):
            n = c[m.group()]
            if done + n <= budget:
                done += n
                continue
            word = m.group()
            counts = c.prefixes(word.encode("utf-8", "surrogatepass"))
            size, best = 0, 0
            for i, ch in enumerate(word, 1):
                size += len(ch.encode("utf-8", "surrogatepass"))
                if done + counts[size] <= budget:
                    best = i
            return m.start() + best
    return len(text)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024, prefixes: bool = False) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars`` (characters of the longest prefix within
    ``limit`` tokens); with ``prefixes`` also ``prefix_tokens``, the count at each of the text's characters.

    A null or empty text has zero bytes and tokens. Rows keep their number and order, repeated rows are counted each on
    their own, columns of ``df`` with one of these names are replaced. No shuffle; a worker holds one batch.
    """
    ship(df.sparkSession)
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())]
    if prefixes:
        made.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    names = {f.name.lower() for f in made}
    kept = [c for c in df.columns if c.lower() not in names]
    (own,) = fresh(df.columns, "own")
    src = df.select(*map(named, kept), named(text).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(own).to_pylist()]
                counts = [c.count(t) for t in texts]
                cols = [part.column(k) for k in kept]
                cols += [
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                    pa.array([fit(c, t, limit) if n > limit else len(t) for t, n in zip(texts, counts, strict=True)], pa.int64()),
                ]
                if prefixes:
                    cols.append(pa.array([c.at_every_prefix(t)[1:].tolist() for t in texts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [*kept, *(f.name for f in made)])

    return mapped(src, run, T.StructType([*(df.schema[c] for c in kept), *made]))
