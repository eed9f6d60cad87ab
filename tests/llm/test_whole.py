"""What the review of round 1 found to be less than the whole job."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb

from tessella.llm import simhash
from tessella.llm.queries import ORACLES, QUERIES


def test_pipeline_links_all_near_copies(spark, frame):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for n in [*range(6, 12), *[rng.randint(12, 300) for _ in range(60)]]:
        w = [word() for _ in range(n)]
        texts.append(w)
        for changes in (1, 1, 2, 4, 8):  # up to five shingles each
            v = list(w)
            for _ in range(min(changes, n // 40 + 1)):
                v[rng.randrange(n)] = word()
            texts.append(v[: n - rng.randint(0, n // 20)])
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if (both := len(a & sets[j])) * 10 >= 8 * (len(a) + len(sets[j]) - both):
                far += (simhash.fingerprint(" ".join(texts[i]).encode(), 5) ^ simhash.fingerprint(" ".join(texts[j]).encode(), 5)).bit_count() > 3
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert far > 50
    docs = frame([(i, " ".join(w), "en", "web", 1) for i, w in enumerate(texts)] + [(1000, None, "", "", 0), (1001, "", "", "", 0), (None, " ", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [*(i for i in range(len(texts)) if find(i) == i), 1000]


def test_long_conversations_like_the_oracle(spark, frame, tmp_path):
    rng = random.Random(4)
    rows = []
    for c, (n, step) in enumerate([(700, 1), (400, 256), (300, 1000), (513, 1), (256, 1), (257, 1), (3, 5000), (600, 0)]):
        for i in range(n):
            role = "system" if i == 0 and c % 2 == 0 else ("user", "assistant")[i % 2]
            rows.append((c, i * step, role, f"{i:05d} " + " ".join("word" for _ in range(rng.choice([0, 3, 30, 90, 300])))))
    rows += [(50, t, r, f"{i:05d} a b") for i, (t, r) in enumerate([(0, "system"), *[(7, "user")] * 1500, *[(300, "assistant")] * 40])]
    frame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = QUERIES["op4_chat_format"](spark, str(tmp_path)), con.execute(ORACLES["op4_chat_format"]).df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.to_numpy().tolist()))
