"""The pipeline and the classifiers against plain versions, written as loops over lists."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import lines, pieces, quality, toxicity
from tessella.llm._shared import fold_of, stored, table
from tessella.llm.queries import QUERIES, tokenizer_path

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def text_hash(t):
    h = xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42
    return h - (1 << 64) if h >> 63 else h


def plain_score(model, text):
    found = set()
    for w in re.findall(rb"[a-z'\x80-\xff]+", (text or "").encode().lower()):
        found.add((0, w))
        for n in (4, 5, 6, 7):
            if len(w) > n:
                found.add((1, w[:n]))
    z = model.bias + sum((model.starts if start else model.words).get(w, 0.0) for start, w in found)
    return 1 / (1 + math.exp(-z))


def plain_lines(rows):
    seen, left = [], {}
    for d, t in sorted({r[:2] for r in rows if r[0] is not None and r[1] is not None}, key=lambda r: (r[0], text_hash(r[1]))):
        kept = []
        for line in t.split("\n"):
            w = line.encode().lower().split()
            if len(b" ".join(w)) >= 10:
                again = any(w == s or (min(len(w), len(s)) >= 8 and lines.near(w, s)) for s in seen)
                seen.append(w)
                if again:
                    continue
            kept.append(line)
        left[d, t] = "\n".join(kept)
    out = []
    for d, t, lang, source, n in rows:
        t = left.get((d, t), t)
        out.append((d, t, lang, source, len(t) if t is not None else n))
    return out


def plain_groups(rows):
    """One row of each group of near-duplicates."""
    sets, codes = [], []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        every = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
        sets.append(s)
        codes.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in every) > len(every)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both, b = len(a & sets[j]), sets[j]
            if a == b or (a and b and 10 * both >= 8 * len(a | b) and (codes[i] ^ codes[j]).bit_count() <= 24):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]), *r[2:])) for g in groups.values()]


def plain_clean(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in items:
        w = word.findall(t.encode().lower().decode())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = []
    for r in rows:
        w = word.findall((r[1] or "").encode().lower().decode())
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        run = max((len(x) for x in "".join("x" if h else " " for h in hit).split()), default=0)
        if run < 13 and not (any(hit) and 20 * sum(hit) >= len(w)):
            out.append(r)
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulmnrsté") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    para = lambda: "\n".join(say(rng.randint(4, 20)) for _ in range(rng.randint(2, 6)))
    items = [say(rng.randint(20, 40)) for _ in range(8)] + ["only four words here"]
    texts = [para() for _ in range(60)]
    planted = set()
    for k, item in enumerate(items[:8]):  # in short documents, in one of many words, and between other words of a line
        planted |= {len(texts), len(texts) + 1}
        texts += [f"{para()}\n{re.sub('[a-z]', lambda m: m[0].upper(), item)}\n{say(5)}", f"{say(900)}\n{say(9)} {item}, {say(9)}" if k % 2 else f"{say(6)} {item}"]
    texts += [f"only four words here {say(200)}", "only four words here and more"]
    toxic = set()
    for i in range(120):
        if i % 3 == 0:
            toxic.add(len(texts))
        texts.append(f"{say(30)} vilexo {say(10)}" if i % 3 == 0 else f"{say(30)} {say(10)}")
    for i in range(12):  # exact and near copies
        w = texts[i].split(" ")
        texts += [texts[i], " ".join(w[:-1] + ["changed"]), texts[i].replace("\n", " ")]
    texts += [texts[3].split("\n")[0] + "\n" + para(), "", " \n\t", None, None, "long " * 9000, say(4000)]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "en", "web", len(texts[4])), (4, texts[4], "de", "web", len(texts[4])), (5, para(), "en", "web", 1), (None, para(), "en", None, None), (None, texts[9], None, "x", 3)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DDL).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts)) if i % 2 or i in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items, planted, toxic


def test_pipeline_equals_plain_versions(spark, corpus):
    at, rows, items, planted, toxic = corpus
    docs = table(spark, at, "documents")
    model = toxicity.fit(docs, table(spark, at, "labels"), fold_of("doc_id", 3) != 1)
    plain = {
        "toxicity": lambda rows: [r for r in rows if plain_score(model, r[1]) < 0.7],
        "line_dedup": plain_lines,
        "simhash_near_dedup": plain_groups,
        "benchmark_decontamination": lambda rows: plain_clean(rows, items),
    }
    extra = ["th", "doc", "own", "score", "gone", "root", "row", "lost", "hash", "id", "a.b", "n_removed", "pieces", "__text"]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs.withColumns({c: F.lit("clash") for c in extra}), at), name)
        if name == "sentencepiece":
            break
        want = plain[name](rows)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert Counter(map(tuple, out.collect())) == Counter(want), name
        docs, rows = out, want
    last = {r[0] for r in rows}
    assert not last & planted and len(planted) == 16 and len(toxic - last) > 30
    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = out.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    assert all(r.lossless and processor.decode(list(r.pieces)) == (r.text or "") for r in got)
    assert Counter((r.doc_id, tuple(r.pieces)) for r in corpus_pipeline.run(spark, at).collect()) == Counter((r.doc_id, tuple(r.pieces)) for r in got)


def test_stages_take_empty_tables(spark, corpus):
    at = corpus[0]
    none = table(spark, at, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).count() == 0, name


def test_token_query_counts_like_the_library(spark):
    at = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, at).collect()}
    rows = table(spark, at, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 1024)


def test_piece_query_decodes_to_every_text(spark):
    at = "/root/testdata/sf0.001"
    got = pieces.segment(table(spark, at, "documents"), tokenizer_path("piece_bpe_32k.model")).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    query = {r.doc_id: r for r in QUERIES["op3_sentencepiece_sampling"](spark, at).collect()}
    for r in got:
        assert processor.decode(list(r.pieces)) == (r.text or "") and query[r.doc_id].pieces_sha256 == r.pieces_sha256 and query[r.doc_id].lossless


def test_quality_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    texts = [b"One two, three. " * 40, b"", b"A b c! " * 10, b"x" * 100]
    bags = [quality.encode(t) for t in texts]
    m = quality.train(bags, [1, 0, 1, 0], rounds=2)
    y, w = np.array([1.0, 0, 1, 0]), np.array([0.1, 0.3, 0.2, 0.4])

    def loss():
        f = m.score(bags)
        return float(-(w * (y * np.log(f) + (1 - y) * np.log(1 - f))).sum())

    g = m.gradient(bags, y, w)
    for k, p in m.p.items():
        flat, own = p.reshape(-1), g[k].reshape(-1)
        for i in np.flatnonzero(own)[:20] if k == "E" else rng.integers(0, len(flat), 20):
            at = flat[i]
            flat[i] = at + 1e-5
            up = loss()
            flat[i] = at - 1e-5
            down = loss()
            flat[i] = at
            assert abs((up - down) / 2e-5 - own[i]) < 1e-6, k


def test_quality_scores_equal_a_plain_walk():
    """Passage by passage, number by number, from the definition of gated attention."""
    rng = random.Random(5)
    texts = [b"", None, b"Word, another! 12 " * 30, " ".join("é" * rng.randint(1, 9) for _ in range(200)).encode()]
    m = quality.train([quality.encode(t) for t in texts], [0, 1, 0, 1], rounds=3)
    p = m.p
    sig = lambda x: 1 / (1 + math.exp(-x))
    for text, score in zip(texts, m.score([quality.encode(t) for t in texts]), strict=True):
        hidden, energy = [], []
        for row, words in zip(*quality.encode(text), strict=True):
            known = [w for w in words if w]
            said = [sum(p["E"][w][k] for w in known) / max(len(known), 1) for k in range(quality.WORD)]
            x = [(row[k] - m.mean[k]) / m.scale[k] for k in range(quality.WIDTH)] + said
            h = [math.tanh(sum(x[i] * p["We"][i][j] for i in range(len(x))) + p["be"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * p["V"][i][j] for i in range(len(h))) + p["bv"][j]) * sig(sum(h[i] * p["U"][i][j] for i in range(len(h))) + p["bu"][j]) for j in range(quality.GATE)]
            hidden.append(h)
            energy.append(sum(g * w for g, w in zip(gate, p["w"], strict=True)))
        weight = [math.exp(e - max(energy)) for e in energy]
        z = [sum(a * h[j] for a, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(quality.HIDDEN)]
        assert score == pytest.approx(sig(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["b"][0]), abs=1e-6)


def test_toxicity_equals_plain_training():
    """The same steps, text by text and weight by weight; the gradient by differences of the corrected risk."""
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(25))
    bad = [f"{plain()} {rng.choice(['vilex', 'grimpaz'])} {plain()}".encode() for _ in range(60)]
    other = [(f"{plain()} vilex" if i % 9 == 0 else plain()).encode() for i in range(200)]
    m = toxicity.train(bad, other, 0.1, rounds=12)
    names = sorted([b"=" + w for w in m.words] + [b"^" + w for w in m.starts])
    have = lambda t: [f for f in names if f in toxicity.features(t)]
    positive, unlabelled = [have(t) for t in toxicity.different(bad)], [have(t) for t in toxicity.different(other)]
    weight, bias = dict.fromkeys(names, 0.0), 0.0
    soft = lambda z: math.log1p(math.exp(z)) if z < 30 else z
    keys = [*names, None]
    first, second = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
    raw = lambda fs, w, b: b + sum(w[f] for f in fs)

    def parts(w, b):
        z_p, z_u = [raw(x, w, b) for x in positive], [raw(x, w, b) for x in unlabelled]
        rest = sum(map(soft, z_u)) / len(z_u) - 0.1 * sum(map(soft, z_p)) / len(z_p)
        return 0.1 * sum(soft(-z) for z in z_p) / len(z_p), rest

    for t in range(1, 13):
        below = parts(weight, bias)[1] < 0
        goal = lambda w, b: -parts(w, b)[1] if below else sum(parts(w, b))  # noqa: E731, B023
        grad = {}
        for f in keys:
            step = 1e-5
            up = goal({**weight, f: weight[f] + step}, bias) if f else goal(weight, bias + step)
            down = goal({**weight, f: weight[f] - step}, bias) if f else goal(weight, bias - step)
            grad[f] = (up - down) / (2 * step) + (3e-5 * weight[f] if f else 0)
        for f in keys:
            first[f], second[f] = 0.9 * first[f] + 0.1 * grad[f], 0.999 * second[f] + 0.001 * grad[f] ** 2
            move = 0.1 * (first[f] / (1 - 0.9**t)) / (math.sqrt(second[f] / (1 - 0.999**t)) + 1e-8)
            if f:
                weight[f] -= move
            else:
                bias -= move
    assert names and m.bias == pytest.approx(bias, abs=1e-4)
    for f in names:
        assert (m.words if f[:1] == b"=" else m.starts)[f[1:]] == pytest.approx(weight[f], abs=1e-4)
    for text in (bad[0], other[1], b""):
        assert 1 / (1 + math.exp(-m.raw(text))) == pytest.approx(plain_score(m, text.decode()))
