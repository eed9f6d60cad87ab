"""Sampled segmentations of text into SentencePiece pieces, and back.

The lattice of a text has an edge for every piece that matches between two positions; characters that no piece spells
have an edge of byte pieces. Forward filtering sums, for each position, the weights of all ways to reach it. Backward
sampling starts at the end and draws each edge in proportion to its weight times what was summed where it starts, which
gives each segmentation its exact share. No piece has a word mark behind another character, so the lattice falls apart at
word marks and is filtered once per different word; draws are counters hashed with the row's key, so a row has the same
pieces wherever and with whatever other rows it is processed.

A piece of rank r weighs (r + OFFSET) ** -SHARPNESS, a byte piece FALLBACK; with ``best`` the heaviest way is taken
instead of a drawn one.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm._shared import fresh, mapped, named, ship

MARK = "▁"  # fixed value: stands for a space at the beginning of pieces
OFFSET, SHARPNESS, FALLBACK = 100.0, 1.5, 1e-9
SCALE = 64.0  # per character, on every weight: keeps sums in range and changes no chance
BASE = 0x100000001B3  # of the hash of stretches
HELD = "\ud800"
CHUNK = 16384  # characters of a word whose lattice is held at once; longer words are filtered in chunks, as one lattice
GAMMA = np.uint64(0x9E3779B97F4A7C15)  # fixed values of the splitmix64 generator
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniforms(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), fixed by key and counter."""
    with np.errstate(over="ignore"):
        z = key + (count.astype(np.uint64) + np.uint64(1)) * GAMMA
        z = (z ^ (z >> np.uint64(30))) * MIX1
        z = (z ^ (z >> np.uint64(27))) * MIX2
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def key_of(row: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{row}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Lattice:
    """The pieces of a model, and words filtered so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.byte_id = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if m.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces; without them some texts cannot be spelt")
        plain = [i for i in range(len(self.names)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-m.get_score(i), i)))}
        self.piece = {self.names[i]: (i, (rank[i] + OFFSET) ** -SHARPNESS) for i in plain}
        self.longest = max(map(len, self.piece))
        self.powers = np.array([pow(BASE, i, 1 << 64) for i in range(self.longest)], np.uint64)
        if any(MARK in n.lstrip(MARK) for n in self.piece):
            raise ValueError("a piece has a word mark inside, words are not independent")
        marks = set(MARK + HELD)
        sharp = {c for c in "\n" + string.punctuation}  # a text may be cut in front of these: no piece has one inside
        while bad := {c for n in self.piece for b, c in zip(n, n[1:], strict=False) if c in sharp and b not in sharp and b not in marks}:
            sharp -= bad
        cls = "".join(map(re.escape, sorted(sharp)))
        self.cut = re.compile(rf"{MARK}+[{cls}]*[^{MARK}{cls}]*|[{cls}]+[^{MARK}{cls}]*|[^{MARK}{cls}]+" if cls else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.spell = {i: bytes([b]) for b, i in self.byte_id.items()} | {i: n.replace(MARK, " ").encode() for n, (i, _) in self.piece.items()}
        # By length, the hashes of all ends of pieces, with the piece that is the whole of it or -1.
        ends = {n[i:] for n in self.piece for i in range(len(n))}
        self.ends = []
        for size in range(1, self.longest + 1):
            own = sorted((self._hash(e), self.piece[e][0] if e in self.piece else -1) for e in ends if len(e) == size)
            self.ends.append((np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))
        self.weight = np.zeros(len(self.names))
        for i, w in self.piece.values():
            self.weight[i] = w
        self.ascii = np.array([self.byte_id[c] for c in range(128)])

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) & (1 << 64) - 1
        return h

    def words(self, text: str) -> list[str]:
        """Stretches that no piece reaches across. A space is a word mark, and one stands in front; a mark that is in
        the text itself is held apart as a lone surrogate, which no text has, and is spelt in bytes."""
        if MARK in text:
            text = text.replace(MARK, HELD)
        return self.cut.findall(MARK + text.replace(" ", MARK))

    def edges(self, text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of characters side by side, with their places in their words, the edges that end at each: node, length, piece
        (below zero: a character to be spelt in bytes) and weight, in order of node and length."""
        n = len(text)
        at, h = np.arange(n), np.zeros(n, np.uint64)
        nodes, lengths, ids = [], [], []
        with np.errstate(over="ignore"):
            for length, (keys, whole) in enumerate(self.ends, 1):  # stretches that end here and are the end of a piece
                at = at[pos[at] >= length - 1]
                if not len(at):
                    break
                # the hash of the stretch is its first character times BASE ** (length - 1), plus that of its rest
                now = h[at] + (text[at - length + 1] + np.uint64(1)) * self.powers[length - 1]
                place = np.searchsorted(keys, now)
                place[place == len(keys)] = 0
                hit = keys[place] == now
                at = at[hit]
                h[at] = now[hit]
                found = whole[place[hit]]
                is_piece = found >= 0
                nodes.append(at[is_piece])
                ids.append(found[is_piece])
                lengths.append(np.full(len(nodes[-1]), length))
        node, length, piece = np.concatenate(nodes), np.concatenate(lengths), np.concatenate(ids)
        weight = self.weight[piece] * SCALE**length
        bare = np.flatnonzero(np.bincount(node, minlength=n) == 0)  # only bytes spell these characters
        c = text[bare].astype(np.int64)
        node = np.r_[node, bare]
        length = np.r_[length, np.ones(len(bare), np.int64)]
        piece = np.r_[piece, np.where(c < 128, self.ascii[np.minimum(c, 127)], -c)]
        weight = np.r_[weight, np.full(len(bare), FALLBACK * SCALE)]
        order = np.argsort(node, kind="stable")  # edges of a node stay in order of length
        return node[order], length[order], piece[order], weight[order]

    def graph(self, words: list[str], best: bool = False) -> tuple[np.ndarray, ...]:
        """Filter words together. Nodes are their characters, side by side. Returned: the end node of each word; of each
        node its first edge; of each edge the chance of it or an earlier edge of its node, the node where it
        starts (-1: the word's beginning) and its piece (below zero: a character to be spelt in bytes)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(text)
        pos = np.arange(n) - np.repeat(end - size, size)
        node, length, piece, weight = self.edges(text, pos)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        last = np.r_[first[1:], len(node)] - 1
        start = np.where(length > pos[node], -1, node - length)
        total = np.ones(n + 1)  # the last is the words' beginning
        chance = np.empty(len(node))
        by_pos = np.argsort(pos.astype(np.int16), kind="stable")
        border = np.searchsorted(pos[by_pos], np.arange(int(pos.max()) + 2))
        fold = np.maximum if best else np.add
        for p in range(len(border) - 1):
            here = by_pos[border[p] : border[p + 1]]
            count = last[here] - first[here] + 1
            cut = np.cumsum(count) - count
            edge = np.repeat(first[here] - cut, count) + np.arange(int(count.sum()))
            part = weight[edge] * total[start[edge]]
            total[here] = fold.reduceat(part, cut)
            chance[edge] = part / np.repeat(total[here], count)
            if p % self.longest == self.longest - 1:  # only ratios matter: bring what pieces still reach back to near one
                near = (here[:, None] - np.arange(self.longest)).ravel()
                total[near] = np.ldexp(total[near], np.repeat(-np.frexp(total[here])[1], self.longest))
        if best:
            chance = (chance >= 1).astype(float)
        step, more = first.copy(), last > first
        while more.any():  # running sums within nodes, one edge after the other so that they do not depend on what else is there
            step = step[more] + 1
            chance[step] += chance[step - 1]
            more = last[node[step]] > step
        if best:
            chance = np.minimum(chance, 1)
        chance[last] = 1.0
        return end - 1, first, chance, start, piece

    def _chunk(self, word: str, lo: int, hi: int, before: list[float], best: bool) -> tuple[list, list[float]]:
        """Filter characters ``lo`` to ``hi`` of a word, given the sums ``before`` at ``lo`` and up to ``longest`` places
        earlier. Returned: of each character its edges, as running chance, length and piece; the last sums."""
        base = lo + 1 - len(before)  # the place of the first of these sums
        text = np.frombuffer(word[base:hi].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        node, length, piece, weight = self.edges(text, np.arange(len(text)))
        first = np.searchsorted(node, np.arange(lo - base, len(text) + 1)).tolist()
        length, piece, weight = length.tolist(), piece.tolist(), weight.tolist()
        total, out = list(before), []
        for i, (a, b) in enumerate(zip(first, first[1:], strict=False), len(before)):
            part = [weight[e] * total[i - length[e]] for e in range(a, b)]
            whole = max(part) if best else sum(part)
            upto, row = 0.0, []
            for e, x in zip(range(a, b), part, strict=True):
                upto = max(upto, float(x >= whole)) if best else upto + x / whole
                row.append((upto, length[e], piece[e]))
            row[-1] = (1.0, *row[-1][1:])
            out.append(row)
            total.append(whole)
            if i % self.longest == 0:  # only ratios matter: bring what pieces still reach back to near one
                shift = -math.frexp(whole)[1]
                total[-self.longest :] = [math.ldexp(x, shift) for x in total[-self.longest :]]
        return out, total[-self.longest :]

    def _long(self, word: str, key: int, count: int, best: bool) -> np.ndarray:
        """A segmentation of one word of any length: forward over chunks, of which only the last sums are kept, then
        backward over the same chunks, each filtered again."""
        cuts = [*range(0, len(word), CHUNK), len(word)]
        before = [[1.0]]
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            before.append(self._chunk(word, lo, hi, before[-1], best)[1])
        at, out, drawn = len(word), [], 0
        u: list[float] = []
        for lo, hi, sums in zip(reversed(cuts[:-1]), reversed(cuts[1:]), reversed(before), strict=True):
            edges = self._chunk(word, lo, hi, sums, best)[0]
            while at > lo:
                if drawn % CHUNK == 0:
                    u = uniforms(np.uint64(key), np.arange(count + drawn, count + drawn + CHUNK)).tolist()
                x = u[drawn % CHUNK]
                length, piece = next((n, p) for chance, n, p in edges[at - lo - 1] if x < chance)
                out.append(piece)
                at -= length
                drawn += 1
        return np.array(out[::-1], np.int64)

    def sample(self, texts: list[str], keys: list[int], best: bool = False) -> list[np.ndarray]:
        """A segmentation of each text."""
        number: dict[str, int] = {}
        each, sizes, offset, long_ones = [], [], [], []
        for row, t in enumerate(texts):
            found = self.words(t) if t else []
            sizes.append(len(found))
            place = 0  # draws of a word are counted from its place in the text: it has no more than characters
            for w in found:
                offset.append(place)
                place += len(w)
                if len(w) > CHUNK:
                    long_ones.append((len(each), row, w))
                    w = MARK  # stands in
                each.append(number.setdefault(w, len(number)))
        if not each:
            return [np.zeros(0, np.int64) for _ in texts]
        end_node, first, chance, start, piece = self.graph(list(number), best)
        sizes = np.array(sizes, np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        begin = np.cumsum(sizes) - sizes
        count = np.array(offset, np.int64)
        key = np.array(keys, np.uint64)[row]
        at, node, drawn = np.arange(len(row)), end_node[np.array(each, np.int64)], []
        long = np.zeros(len(row), np.int64)
        while len(at):
            u = uniforms(key[at], count[at] + long[at])
            edge = first[node]
            go = np.flatnonzero(u >= chance[edge])
            while len(go):
                edge[go] += 1
                go = go[u[go] >= chance[edge[go]]]
            drawn.append((at, piece[edge]))
            long[at] += 1
            node = start[edge]
            go = node >= 0
            at, node = at[go], node[go]
        spelt = {i: self._long(w, keys[r], offset[i], best) for i, r, w in long_ones}
        for i, got in spelt.items():
            long[i] = len(got)
        end = np.cumsum(long)
        out = np.empty(int(end[-1]), np.int64)
        for step, (at, got) in enumerate(drawn):
            out[end[at] - 1 - step] = got
        for i, got in spelt.items():
            out[end[i] - len(got) : end[i]] = got
        border = np.r_[0, end][np.r_[begin, len(row)]]
        parts = [out[a:b] for a, b in zip(border[:-1], border[1:], strict=True)]
        return [self._spelt(p) if len(p) and p.min() < 0 else p for p in parts]

    def _spelt(self, part: np.ndarray) -> np.ndarray:
        out = []
        for i in part.tolist():
            if i >= 0:
                out.append(i)
            else:
                c = MARK if chr(-i) == HELD else chr(-i)
                out.extend(self.byte_id[b] for b in c.encode("utf-8", "surrogatepass"))
        return np.array(out, np.int64)

    def decode(self, part: np.ndarray) -> str:
        """The text: marks are spaces, byte pieces are bytes, and the mark in front goes."""
        spell = self.spell
        return b"".join([spell[i] for i in part.tolist()])[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def segment(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", seed: int = 0, best: bool = False, pieces: bool = True, slice_bytes: int = 2 << 20) -> DataFrame:
    """``df`` with ``pieces`` (ids; only if asked for), ``n_pieces``, ``pieces_sha256`` (of the ids as four bytes each, least first) and
    ``lossless``, whether decoding the pieces gives the text back.

    Null and empty texts have no pieces and decode to the empty text. Rows keep their number and order; rows with equal
    key and text have equal pieces, a null key counts as the empty string; a column named like one that is made is
    replaced. A very long text is one task's work, also if it is one word. No shuffle; a worker holds the lattice of one slice of
    ``slice_bytes``, and larger slices share more words.
    """
    ship(df.sparkSession)
    made = ([T.StructField("pieces", T.ArrayType(T.IntegerType()))] if pieces else []) + [T.StructField("n_pieces", T.LongType()), T.StructField("pieces_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]
    kept = [c for c in df.columns if c.lower() not in {"pieces", "n_pieces", "pieces_sha256", "lossless"}]
    own, row = fresh(df.columns, "own", "row")
    src = df.select(*map(named, kept), named(text).alias(own), named(key).cast("string").alias(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            step = max(1, min(1000, batch.num_rows * slice_bytes // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [t or "" for t in part.column(own).to_pylist()]
                found = model.sample(texts, [key_of(k or "", seed) for k in part.column(row).to_pylist()], best)
                cols = [part.column(c) for c in kept]
                if pieces:
                    cols.append(pa.array([p.tolist() for p in found], pa.list_(pa.int32())))
                cols += [
                    pa.array([len(p) for p in found], pa.int64()),
                    pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in found]),
                    pa.array([model.decode(p) == t for p, t in zip(found, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(cols, [*kept, *(f.name for f in made)])

    return mapped(src, run, T.StructType([*(df.schema[c] for c in kept), *made]))


def decode(df: DataFrame, path: str, pieces: str = "pieces", column: str = "decoded") -> DataFrame:
    """``df`` with the text that ``pieces`` spell; null pieces give the empty text."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() != column.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            got = [model.decode(np.array(p or [], np.int64)) for p in batch.column(pieces).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, pa.string())], [*kept, column])

    return mapped(df, run, T.StructType([*(df.schema[c] for c in kept), T.StructField(column, T.StringType())]))
