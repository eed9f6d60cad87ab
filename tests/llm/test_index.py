"""What the review of round 2 found to be less than the method that is named."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from tessella.llm import _shared, simhash


def near_copies(seed: int) -> list[list[str]]:
    """Texts, each with copies of which 0.8 or a little more of all shingles are common, and others that share half."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for n in [8, 9, 12, 30, *[rng.randint(50, 300) for _ in range(40)]]:
        w = [word() for _ in range(n)]
        end = max(1, (n - 4) // 10)  # shingles that a copy has not; as many are its own
        texts += [w, w[:-end] + [word() for _ in range(end)], w[: n - 2 * end], w[: n // 2] + [word() for _ in range(n // 2)]]
    return texts


def test_near_duplicates_of_the_pipeline_come_from_the_index(spark, frame, monkeypatch):
    asked = []
    searched = simhash._searched
    monkeypatch.setattr(simhash, "_searched", lambda member, sizes, members, k, *more: asked.append(k) or searched(member, sizes, members, k, *more))
    docs = frame([(i, " ".join(w), "en", "web", 1) for i, w in enumerate(near_copies(1))], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").count() < docs.count()
    assert asked == [corpus_pipeline.BITS]


def test_candidates_hold_all_alike_texts_and_no_unlike_ones(frame, monkeypatch):
    sets = [np.unique(np.array(simhash.hashes([x.encode() for x in w], 5), np.uint64)) for w in near_copies(2)]
    fps = np.array([simhash.majority(s.tolist()) for s in sets], np.uint64)
    rows = [(i, int(f), simhash.wide(s).view(np.int64).tolist()) for i, (f, s) in enumerate(zip(fps.view(np.int64), sets, strict=True))]
    codes = frame(rows, "code long, fp long, list array<bigint>")

    def groups():
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in simhash.candidates(codes, len(rows), 24, 0.8).collect():
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(sets))]

    found, alike = groups(), 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9 and int(fps[i] ^ fps[j]).bit_count() <= 24:
                alike += 1
                assert found[i] == found[j]
            assert i // 4 == j // 4 or found[i] != found[j]
    assert alike > 40 and len(set(found)) >= 44
    # masks of few bits, so that groups are large; in one task or over many nodes they give the same
    few = [np.arange(at, at + 3) for at in range(0, 18, 3)]
    monkeypatch.setattr(simhash, "blocks", lambda n, share: few)
    whole = groups()
    monkeypatch.setattr(simhash, "NODE", 16)
    monkeypatch.setattr(simhash, "UPPER", 2)
    assert groups() == whole and len(set(whole)) < len(sets)


def test_links_of_near_copies_grow_no_faster_than_their_number(frame, monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 32)
    monkeypatch.setattr(simhash, "UPPER", 4)
    edges, stored = [], simhash.stored

    def counted(df, name="step", rows=None):
        out = stored(df, name, rows)
        edges.append((name, out.count()))
        return out

    for module in (simhash, _shared):
        monkeypatch.setattr(module, "stored", counted)
    rng = np.random.default_rng(3)
    first = rng.integers(1 << 63, size=(2, 200), dtype=np.uint64)

    def copy(i):  # of every 50 one is a copy of another text
        own = first[int(i % 50 == 0)].copy()
        own[rng.choice(200, 10, replace=False)] = rng.integers(1 << 63, size=10, dtype=np.uint64)
        return np.unique(own)

    most = {}
    for n in (250, 1000):
        sets = [copy(i) for i in range(n)]
        rows = [(i, int(np.uint64(simhash.majority(s.tolist())).view(np.int64)), simhash.wide(s).view(np.int64).tolist()) for i, s in enumerate(sets)]
        codes = frame(rows, "code long, fp long, list array<bigint>")
        edges.clear()
        tree = _shared.components(simhash.candidates(codes, n, 24, 0.8))
        root = {r.node: r.root for r in tree.collect()}
        assert {root.get(i, i) for i in range(n) if i % 50} == {1} and {root.get(i, i) for i in range(0, n, 50)} == {0}
        most[n] = max(rows for name, rows in edges if name == "edges")
        assert any(name == "pairs" for name, _ in edges)  # some groups have many nodes
    assert most[1000] <= 4 * simhash.FIRST * 1000 and most[1000] <= 6 * most[250], most


def test_masks_of_wide_fingerprints_miss_few():
    rng = np.random.default_rng(1)
    for n in (1000, 200_000, 15_000_000):
        kept = simhash.blocks(n, 0.8)
        assert (2 * n // simhash.NODE) >> len(kept[0]) == 0
        differ = rng.random((20_000, 64 * simhash.WORDS)) < simhash.differing(0.8)
        missed = np.all([differ[:, b].any(axis=1) for b in kept], axis=0).sum()
        assert missed <= 5
