"""The operators on small tables: against brute force, and on nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import _shared, ann, chat, decontam, lines, pieces, quality, simhash, suffix, tokencount, toxicity
from tessella.llm.queries import QUERIES, tokenizer_path

DOC = "doc_id long, text string"
EDGES = [(None, None), (None, "same words here"), (7, None), (8, ""), (9, " \n\t "), (10, "same words here"), (10, "same words here"), (11, "x" * 50_000), (12, "é" * 3), (13, "long " * 9000)]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_components(spark, frame):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in _shared.components(frame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert _shared.components(frame([], "a long, b long")).count() == 0


def groups_by_force(rows, width, k):
    words = [(t or "").encode().lower().split() for _, t in rows]
    fps = np.array([simhash.fingerprint(b" ".join(w), width) for w in words], dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= k):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{int(f):016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(rng.randint(3, 60))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        out.append((i + 100, " ".join(w)))
    return out


@pytest.mark.parametrize(("node", "upper"), [(2048, 64), (8, 64), (4, 2)])
def test_near_duplicates_equal_brute_force(frame, monkeypatch, node, upper):
    monkeypatch.setattr(simhash, "NODE", node)
    monkeypatch.setattr(simhash, "UPPER", upper)
    rows = near_texts(150, node) + EDGES
    df = frame([(*r, 1) for r in rows], DOC + ", fp int")
    assert Counter(tuple(r)[:3] for r in simhash.near_duplicates(df, width=3, k=3).collect()) == groups_by_force(rows, 3, 3)
    assert simhash.near_duplicates(frame([], DOC)).count() == 0


def test_token_counts_of_edges(frame):
    df = frame([(*r, "kept", 5) for r in EDGES], DOC + ", note string, N_TOKENS int")
    got = tokencount.token_counts(df, tokenizer_path("byte_bpe_50k.json"), limit=20, prefixes=True)
    assert got.columns == ["doc_id", "text", "note", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_tokens"]
    rows = got.collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.n_bytes == len((r.text or "").encode()) and len(r.prefix_tokens) == len(r.text or "")
        assert r.n_tokens == (r.prefix_tokens[-1] if r.text else 0) and r.over_limit == (r.n_tokens > 20)
    assert tokencount.token_counts(df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_segments_of_edges(frame):
    path = tokenizer_path("piece_bpe_32k.model")
    df = frame([(*r, 1) for r in EDGES], DOC + ", lossless int")
    got = pieces.segment(df, path)
    rows = got.collect()
    assert len(rows) == len(EDGES) and all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)
    twice = [r.pieces for r in rows if r.doc_id == 10]
    assert twice[0] == twice[1]
    assert all((r.text or "") == r.decoded for r in pieces.decode(got, path).collect())
    assert [r.pieces for r in pieces.segment(df.repartition(3), path).orderBy("doc_id", "text").collect()] == [r.pieces for r in got.orderBy("doc_id", "text").collect()]
    assert [r.pieces for r in pieces.segment(df, path, seed=1).orderBy("doc_id", "text").collect()] != [r.pieces for r in got.orderBy("doc_id", "text").collect()]


def talks(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(learnt), sha(learnt))
    return out


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (40, 10), (5, 0)])
def test_chat_windows_read_back(frame, budget, history):
    rng = random.Random(budget)
    bits = ["\\", "<", "[", "|im_start|>", "|im_end|>", "\n", "/s>", "/INST]", "INST]", "<SYS>>", "a b", "é", "\\n", "<|im_end|>\n", "😀"]
    rows = [(c, t, "system" if t == 0 else rng.choice(["user", "assistant", *(["as\nsist%"] if t != 3 else [])]), "".join(rng.choice(bits if t != 3 else ["a b", "é"]) for _ in range(rng.randint(0, 9)))) for c in (1, 2, None) for t in [*range(rng.choice([4, 600])), 3, 3]]
    rows += [(9, None, None, None), (9, 1, "assistant", None), (9, 300, "assistant", "x"), (9, 301, "assistant", "y"), (9, -4, "system", "sys")]
    got = chat.windows(frame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int"), budget=budget, history=history)
    by = {}
    for r in sorted(chat.read_back(got).collect(), key=lambda r: (r.block is not None, r.block or 0, r.window)):
        by.setdefault(r.conv_id, []).append(r)
    found = {}
    for c, ws in by.items():
        learnt = "".join(x for w in ws for x in w.learnt)
        found[c] = (sum(len(w.turns) for w in ws), sha("".join(f"{t.role}\n{t.text}\n" for w in ws for t in w.turns)), len(learnt), sha(learnt))
    assert found == talks(rows)
    assert all("system" in r.formatted[:20] for r in got.where("conv_id = 1").collect())
    assert chat.windows(frame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_contamination_equals_brute_force(frame, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["Red", "blue", "grün", "x1", "y"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", ", "]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([0, 1, 2, 3, 5, 13, 14, 20])] + [(3, "again y y"), (50, None), (None, "y x1 y"), (60, "nowhere to be found")]
    docs = [(i, say(rng.randint(0, 40)) + (items[rng.randrange(8)][1] if i % 2 else "") + say(3)) for i in range(60)] + EDGES
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").encode().lower().decode())
    want = Counter()
    wins = {(tuple(w[i : i + 5]), str(k)) for k, t in items if k is not None and (w := split(t)) for i in range(max(1, len(w) - 4))}
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for win, k in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(k)
        want[d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for size in (2_000_000, 4):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", size)
        got = decontam.contamination(frame([(*r, 1) for r in docs], DOC + ", n_words int"), frame(items, "item_id long, text string"), window=5)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    clean = decontam.contamination(frame(docs, DOC), frame([], "item_id long, text string"))
    assert clean.where("contaminated or n_hit > 0").count() == 0 and clean.count() == len(docs)


def test_suffix_dedup_equals_brute_force(frame, monkeypatch):
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    parts = [say(rng.randint(20, 150)) for _ in range(9)]
    rows = [(d, "".join(rng.choice([rng.choice(parts), say(rng.randint(1, 30))]) for _ in range(rng.randint(0, 10)))) for d in range(40)]
    rows += [(100, rows[3][1]), (5, rows[5][1]), (200, None), (201, ""), (202, "a" * 300), (203, "ab" * 90 + say(5) + "ab" * 60), (None, rows[7][1] + "é" * 50)]
    window = 40
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    want = Counter()
    for (d, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        want[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    for group, most in ((256, 1 << 20), (2, 100)):
        monkeypatch.setattr(suffix, "GROUP", group)
        monkeypatch.setattr(suffix, "BUCKET", max(1, group // 4))
        monkeypatch.setattr(suffix, "BROADCAST_BYTES", most)
        got = suffix.remove_repeats(frame([(*r, 1) for r in rows], DOC + ", row int"), window=window)
        assert Counter(tuple(r)[:5] for r in got.collect()) == want
    assert suffix.remove_repeats(frame([], DOC)).count() == 0


@pytest.mark.parametrize(("least_bytes", "least_words", "most"), [(10, 8, 1 << 20), (1, 3, 60), (20, 1000, 1 << 20)])
def test_line_dedup_equals_brute_force(frame, monkeypatch, least_bytes, least_words, most):
    rng = random.Random(5)
    say = ["alpha", "beta", "gamma", "d", "eps", "zeta", "Eta", "theta"]
    base = [" ".join(rng.choice(say) for _ in range(n)) for n in (1, 3, 7, 8, 8, 9, 10, 12, 13, 14, 16, 17, 20, 33)]

    def edit(line):
        w = line.split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.choice([0, 1])] = [rng.choice(say)] * rng.choice([0, 1])
        return " ".join(w)

    # ids 0 to 9 stand for two or three different texts
    rows = [(d % 50, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(0, 9)))) for d in range(60)]
    rows += [(3, f"{base[7]}\nits own second line is unique and must not go away"), (3, f"{base[7]}\n{base[8]}"), (100, None), (101, ""), (102, "long " * 5000), (102, "long " * 5000), (None, base[5])]
    place = lambda r: (r[0], xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63))
    seen, want = [], {(None, base[5]): base[5]}
    for d, t in sorted({r for r in rows if r[0] is not None and r[1] is not None}, key=place):
        kept = []
        for line in t.split("\n"):
            w = lines.words_of(line.encode())
            if w and len(b" ".join(w)) >= least_bytes:
                again = any(w == s or (min(len(w), len(s)) >= least_words and lines.near(w, s)) for s in seen)
                seen.append(w)
                if again:
                    continue
            kept.append(line)
        want[d, t] = "\n".join(kept)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", most)
    names = DOC + ", th string, doc string, lost string, gone string, `a.b` string, line string, __gone string, `row` string"
    got = lines.dedup_lines(frame([(*r, *([r[1]] * 8)) for r in rows], names), least_bytes=least_bytes, least_words=least_words)
    assert got.columns == ["doc_id", "text", "th", "doc", "lost", "gone", "a.b", "line", "__gone", "row", "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.th, r.text) for r in got.collect()) == Counter((d, t, want.get((d, t), t)) for d, t in rows)
    if most == 60:
        assert lines.dedup_lines(frame([], DOC)).count() == 0 and lines.dedup_lines(frame(EDGES, DOC)).count() == len(EDGES)


def test_neighbours_recall_ties_and_odd_vectors(frame, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 150)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    v[100:200] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3, v[3].tolist()), (900, None), (950, [0.0] * 16), (1000, [float("nan")] + [1.0] * 15), (1050, [None] + [1.0] * 15), (None, v[0].tolist()), (1100, [1.0, 2.0])]
    df = frame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), k=5).collect()
    hits = total = 0
    w = v.astype(float)
    for q in range(0, 500, 50):
        s = w @ w[q] / np.linalg.norm(w, axis=1) / np.linalg.norm(w[q])
        s[q] = -9
        best = np.lexsort((np.arange(500), -np.round(s, 12)))[:5].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(best)), total + 5
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 500, 50))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 150), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize(("module", "label", "name"), [(quality, "quality", "op6_quality_classifier"), (toxicity, "toxic", "op10_toxicity")])
def test_classifiers_held_out_and_edges(spark, frame, module, label, name):
    big = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, big)
    held = got.where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] > 0.96
    docs = frame([(*r, 0.5) for r in EDGES], DOC + ", score double")
    none = frame([], f"doc_id long, {label} int")
    odd = frame([(10, 1), (10, 0), (None, 1), (11, None), (99, 1)], f"doc_id long, {label} int")
    for labels in (none, odd):
        model = module.fit(docs, labels, F.lit(True))
        scores = [r.score for r in module.score(docs, model).collect()]
        assert len(scores) == len(EDGES) and all(0 <= s <= 1 for s in scores)
    assert module.score(docs.limit(0), model).count() == 0
