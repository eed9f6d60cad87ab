"""The cores of the operators, without Spark."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import ann, lines, pieces, quality, simhash, suffix, tokencount, toxicity

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
library, counts = Tokenizer.from_file(BPE), tokencount.counter(BPE)
lattice = pieces.lattice(SP)
text = st.text(alphabet=st.one_of(st.sampled_from(list("ab' \n\t.1éΩ語😀▁<|>relsvt")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(text)
def test_token_count_of_every_prefix(s):
    assert counts.at_every_prefix(s).tolist() == [len(library.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]


@pytest.mark.parametrize("s", ["", "<|endoftext|>", "a <|endoftext|><|endo", "we've  they'll\n\n x", " " * 70 + "y", "a" * 3000, "\x1c\x85　 d"])
def test_token_count_of_special_cases(s):
    assert counts.count(s) == len(library.encode(s, add_special_tokens=False).ids)
    at = counts.at_every_prefix(s)
    for budget in (0, 1, 2, 5):
        fit = tokencount.fit(counts, s, budget)
        assert at[fit] <= budget and (fit == len(s) or counts.count(s) > budget)


@settings(max_examples=100, deadline=None)
@given(st.lists(text, max_size=5))
def test_pieces_decode_to_the_text(texts):
    keys = [pieces.key_of(str(i), 1) for i in range(len(texts))]
    got = lattice.sample(texts, keys)
    processor = sentencepiece.SentencePieceProcessor(model_file=SP)
    for i, (t, p) in enumerate(zip(texts, got, strict=True)):
        assert lattice.decode(p) == t == processor.decode(p.tolist())
        assert lattice.sample([t], [keys[i]])[0].tolist() == p.tolist()  # whatever else is in the batch


def test_long_words_and_controls():
    for t in ("x" * 9000, "語" * 5000, "\x00\x7f▁" * 50, " " * 300):
        assert lattice.decode(lattice.sample([t], [3])[0]) == t


def test_pieces_are_drawn_in_proportion():
    word = "▁thens"

    def ways(s):
        if s == len(word):
            return [((), 1.0)]
        return [((p[0], *t), p[1] * w) for e in range(s + 1, len(word) + 1) if (p := lattice.piece.get(word[s:e])) for t, w in ways(e)]

    share = dict(ways(0))
    total, n = sum(share.values()), 20_000
    seen = Counter(tuple(p.tolist()) for p in lattice.sample(["thens"] * n, [pieces.key_of(str(i), 0) for i in range(n)]))
    assert set(seen) <= set(share)
    assert all(abs(seen[k] / n - w / total) < 0.015 for k, w in share.items())
    assert tuple(lattice.sample(["thens"], [5], best=True)[0].tolist()) == max(share, key=share.get)


def test_long_words_are_one_lattice(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice(["the", "ing", "an", "x", "é", "語", "s", "ation"]) for _ in range(n)) for n in (3, 40, 400, 4000)]
    keys = [pieces.key_of(str(i), 2) for i in range(len(words))]
    texts = [f"{w} and {w}" for w in words]
    assert max(map(len, words)) > 4096
    whole = [[p.tolist() for p in lattice.sample(texts, keys, best)] for best in (False, True)]
    for chunk in (1, 7, 100):
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        assert [[p.tolist() for p in lattice.sample(texts, keys, best)] for best in (False, True)] == whole


def test_long_words_are_drawn_in_proportion_across_chunks(monkeypatch):
    word = "\x01" * 300 + "thens" + "\x01" * 300  # no piece has one beside a letter

    def ways(s):
        if s == 5:
            return [((), 1.0)]
        return [((p[0], *t), p[1] * w) for e in range(s + 1, 6) if (p := lattice.piece.get("thens"[s:e])) for t, w in ways(e)]

    share = dict(ways(0))
    total, n = sum(share.values()), 2000
    monkeypatch.setattr(pieces, "CHUNK", 304)  # a border inside "thens", behind the mark and two of its letters
    spelt = {lattice.piece["\x01"][0], lattice.piece["▁"][0]}
    seen = Counter(tuple(i for i in p.tolist() if i not in spelt) for p in lattice.sample([word] * n, [pieces.key_of(str(i), 0) for i in range(n)]))
    assert set(seen) <= set(share) and len(share) > 3
    assert all(abs(seen[k] / n - w / total) < 0.05 for k, w in share.items())


def test_fingerprint_is_the_majority_of_hashes():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        words = [rng.choice(["Ab", "c", "É", "d-e"]) for _ in range(n)]
        data = " \t".join(words).encode()
        low = [w.encode().lower() for w in words]
        shingles = [b" ".join(low[i : i + 3]) for i in range(n - 2)] or ([b" ".join(low)] if n else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(data, 3) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [1, 31, 33, 700, 3000])
def test_index_finds_all_close_pairs(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 62, max(1, n // 5), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64)
    codes = np.unique(rng.choice(base, n) ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(codes, None, 3) for a, b in zip(x, y, strict=True)}
    want = {(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes) <= 3) if i < j}
    assert got == want


def test_masks_cover_all_differences():
    for n in (10, 10**6, 10**9, 10**12):
        kept = simhash.masks(n, 3)
        rng = random.Random(n)
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(flip & m == 0 for m in kept)


def test_near_lines_are_one_word_apart():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    for a, b in itertools.product(itertools.product("ab", repeat=3), itertools.chain(*(itertools.product("ab", repeat=n) for n in (1, 2, 3, 4, 5)))):
        assert lines.near(list(a), list(b)) == (distance(a, b) <= 1)


def test_equal_windows_elect_one_anchor():
    rng = random.Random(4)
    part = bytes(rng.choice(b"abc") for _ in range(90))
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) + part + bytes(rng.choice(b"abc") for _ in range(30)) for _ in range(4)]
    a = suffix.anchors(texts, 40, 10)
    seen: dict[bytes, set[int]] = {}
    for text, p, lo, hi in zip(a["text"], a["p"], a["lo"], a["hi"], strict=True):
        for s in range(lo, hi + 1):
            seen.setdefault(texts[text][s : s + 40], set()).add(int(p - s))
    assert all(len(v) == 1 for v in seen.values())
    assert sum(len(t) - 39 for t in texts) == sum(int(h - o + 1) for o, h in zip(a["lo"], a["hi"], strict=True))


def test_graph_search_recall_with_a_dense_cluster():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, entry = ann.build(x)
    q = x[::20]
    found = ann.search(x, graph, entry, q, ann.BEAM)
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b[:10])) / 5 for a, b in zip(best, found, strict=True)]) > 0.9


def test_attention_finds_the_passage_that_tells():
    rng = random.Random(2)
    good = [" ".join(rng.choice(["calm", "word", "other", "thing"]) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(5, 300))).encode() for _ in range(120)]
    bad = [g + b" " + b"BUY!! NOW!! " * 30 for g in good]
    m = quality.train([quality.encode(t) for t in good[:80] + bad[:80]], [1] * 80 + [0] * 80)
    y = m.score([quality.encode(t) for t in good[80:] + bad[80:]])
    assert ((y >= 0.5) == ([True] * 40 + [False] * 40)).mean() > 0.95
    assert np.isfinite(m.score([quality.encode(None), quality.encode(b""), quality.encode(b"x" * 200_000)])).all()


def test_positive_unlabelled_learning():
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(40))
    toxic = lambda: f"{plain()} {rng.choice(['vilex', 'vileq', 'grimp'])} {plain()}"
    m = toxicity.train([toxic().encode() for _ in range(200)], [(toxic() if i % 8 == 0 else plain()).encode() for i in range(1600)], 1 / 8)
    score = lambda t: 1 / (1 + np.exp(-m.raw(t.encode())))
    assert np.mean([score(toxic()) > 0.7 for _ in range(100)]) > 0.9
    assert np.mean([score(plain()) < 0.7 for _ in range(100)]) > 0.97
    assert m.raw(None) == m.raw(b"") == m.bias
    assert toxicity.train([], [b"a"], 0.1).raw(b"a") < 0
