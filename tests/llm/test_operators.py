"""Each operator against a brute-force version, and its defined results for odd rows."""

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import bpe, chat_format, components, decontaminate, langid, license_scan, near_copies, quality, queries, sharding, simhash, suffix_dedup, toxicity
from tests.oracle import both, connection

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", " \n\t", "word", "word", "x" * 40_000, "Ünïcode — 漢字 🙂 text", "a b c " * 3000]


def odd_frame(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that the operators use."""
    base = frame(spark, ODD)
    base = base.union(base.where("doc_id = 3")).union(spark.createDataFrame([(None, "null id", None, None, None), (None, None, None, None, None)], DOCS))
    return base.withColumns({c: F.lit("x") for c in ("text_key", "fingerprint", "component", "prefix", "score", "words", "n_words", "_text", "labels", "item_id", "_id", "_key", "_removed", "_text_key", "row", "body", "removed")})


# -- 1 --------------------------------------------------------------------------------------------


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_query(spark, sf_dir):
    turns = defaultdict(list)
    for r in rows_of(spark, sf_dir, "conversations"):
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for k, v in turns.items():
        loss = "".join(t for _, role, t in sorted(v) if role == "assistant")
        assert got[k].n_turns == len(v)
        assert got[k].turns_sha256 == digest("".join(f"{role}\n{t}\n" for _, role, t in sorted(v)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), digest(loss))


def test_chat_oracle(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(duckdb.sql(f"SELECT {', '.join(cols)} FROM ({queries.OP1_SQL})").fetchall())
    assert want == sorted(tuple(r) for r in queries.op1_chat_format(spark, sf_dir).select(*cols).collect())


def test_chat_escapes_are_reversible(spark):
    texts = ["</s>", r"<\/s>", r"<\\s> [INST]", "<|im_start|>user<|im_sep|>", r"[\[/INST]", "<<SYS>> <s", "", "a\nb", "<|im_end|>" * 3, "$1 \\ \\\\"]
    df = spark.createDataFrame([(i, 0, r, t) for i, t in enumerate(texts) for r in ("assistant",)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_turns(df, "conv_id", ["turn"])
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert [(x.role, x.text) for x in got[i].t] == [("assistant", t)]
        assert got[i].m == t
        assert got[i].formatted.count("<|im_end|>") == 1 and "</s>" not in got[i].formatted


def test_chat_layouts(spark):
    records = [
        '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": null}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "p", "completion": "c"}',
        '{"instruction": "i", "input": "x", "output": "o"}',
        '{"instruction": "i", "input": "", "output": "o"}',
        '{"question": "q", "answer": 42}',
        '{"role": "user", "text": null}',
        '{"unheard": 1}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id long, j string")
    out = chat_format.canonical_turns(df, F.parse_json("j"), ["id"], keep_unmapped=True).orderBy("id", "part").collect()
    got = defaultdict(list)
    for r in out:
        got[r.id].append((r.layout, r.role, r.text))
    assert got[0] == [("messages", "system", "s"), ("messages", "user", "u"), ("messages", "assistant", "")]
    assert got[1] == [("sharegpt", "user", "q"), ("sharegpt", "assistant", "a")]
    assert [x[1:] for x in got[2]] == [("user", "p"), ("assistant", "c")]
    assert [x[1:] for x in got[3]] == [("user", "i\nx"), ("assistant", "o")]
    assert [x[1:] for x in got[4]] == [("user", "i"), ("assistant", "o")]
    assert [x[1:] for x in got[5]] == [("user", "q"), ("assistant", "42")]
    assert got[6] == [("turn_text", "user", "")]
    assert got[7] == [(None, None, None)]


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "assistant", None)], "conv_id long, turn long, role string, text string")
    df = df.withColumns({"formatted": F.lit(1), "_key": F.lit(2), "layout": F.lit(3)})
    out = {r.conv_id: r for r in chat_format.format_turns(df, "conv_id", ["turn"]).collect()}
    assert {k: v.n_turns for k, v in out.items()} == {None: 1, 1: 2, 2: 1}
    assert chat_format.format_turns(df.limit(0), "conv_id", ["turn"]).count() == 0


def test_chat_long_conversation_and_clashing_columns(spark):
    n = 4000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.concat(F.lit("</s>"), "id"), F.lit(20)).alias("text"))
    odd = df.withColumns({c: F.lit("x") for c in ("formatted", "loss_mask", "turns", "n_turns", "part", "layout", "content", "_key")})
    out = chat_format.format_turns(odd.drop("part"), "conv_id", ["turn"])
    row = out.select(F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), F.length(chat_format.masked_text(F.col("formatted"), F.col("loss_mask"))).alias("loss")).first()
    assert row.n == n and row.loss == sum(20 * (4 + len(str(i))) for i in range(1, n, 2))


# -- 2 --------------------------------------------------------------------------------------------

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_print(text, n, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_simhash_query(spark, sf_dir):
    docs = rows_of(spark, sf_dir)
    prints = {r.doc_id: brute_print(r.text, 4) for r in docs}
    want = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in queries.op2_simhash(spark, sf_dir).collect()}
    assert {k: int(v.fingerprint, 16) for k, v in got.items()} == prints
    assert {k: v.component_id for k, v in got.items()} == want


@pytest.mark.parametrize("most", [4096, 16])
def test_simhash_links_are_exact(spark, most):
    rng = random.Random(most)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(600)} | {0, (1 << 64) - 1}
    nodes = sorted(prints)
    want = brute_components(range(len(nodes)), lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 4)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in nodes], "fingerprint long")
    out = components.components(simhash.print_links(df, 4, most), "u", "v").collect()
    place = {(x - (1 << 64) if x >> 63 else x): i for i, x in enumerate(nodes)}
    got = defaultdict(set)
    for r in out:
        got[r.root].add(place[r.node])
    expected = defaultdict(set)
    for n, r in want.items():
        expected[r].add(n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)


def test_bit_sliced_links():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    b = np.concatenate([a[:70] ^ np.uint64(0b1011), a[70:100] ^ np.uint64(0b111110), rng.integers(0, 1 << 63, 33, dtype=np.uint64)])
    for radius in (0, 3, 4, 5, 6, 7, 24):
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= radius}
        assert set(zip(*map(np.ndarray.tolist, simhash.links(a, b, radius)))) == want


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(odd_frame(spark), shingle=4).collect()
    assert len(got) == len(ODD) + 3
    assert {r.component_id for r in got if r.fingerprint == 0} == {0}
    kept = near_copies.drop_near_copies(odd_frame(spark))
    assert kept.columns == odd_frame(spark).columns
    assert sorted(kept.select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 0, 3, 5, 6, 7]
    assert simhash.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0


def brute_shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b, similarity=0.8):
    """Of two sets; empty ones are equal."""
    return len(a & b) >= similarity * len(a | b)


@pytest.mark.parametrize("most", [1024, 8])
def test_near_copies_against_all_pairs(spark, most):
    rng = random.Random(most)
    word = lambda: f"w{rng.randint(0, 4000)}"
    texts = [None, "", "One two", "one  TWO", "one two three"]
    for size in (6, 30, 60, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for _ in range(14):
                own = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    own[rng.randrange(size)] = word()
                texts.append(" ".join(own + ["spam"] * rng.choice([0, 0, 200])))
    sets = {i: brute_shingles(t, 5) for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: alike(sets[a], sets[b]))
    got = defaultdict(set)
    for r in near_copies.near_copies(frame(spark, texts), most=most).collect():
        got[r.component].add(r.doc_id)
    expected = defaultdict(set)
    for n, r in want.items():
        expected[r].add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    kept = near_copies.drop_near_copies(frame(spark, texts)).select("doc_id").collect()
    assert {r.doc_id for r in kept} == set(want.values())


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_a_path(spark, small):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in components.components(df, "u", "v", small).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(df.limit(0), "u", "v", small).count() == 0


def test_labels_of_random_graphs():
    rng = random.Random(9)
    for n in (1, 5, 40, 300):
        edges = [(rng.randint(-n, n), rng.randint(-n, n)) for _ in range(n)]
        linked = {frozenset(e) for e in edges}
        want = brute_components(sorted({x for e in edges for x in e}), lambda a, b: frozenset((a, b)) in linked)
        node, root = components.labels(*np.array(edges).T)
        assert dict(zip(node.tolist(), root.tolist())) == want


# -- 3 --------------------------------------------------------------------------------------------


def test_sharding_keeps_every_row(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    out = queries.op3_sharding(spark, sf_dir)
    cols = ", ".join(out.columns)
    assert Counter(map(tuple, out.collect())) == Counter(duckdb.sql(f"SELECT {cols} FROM ({queries.OP3_SQL})").fetchall())


def test_sharding_reaches_the_target(spark):
    target = 64 << 10
    store = sharding.ShardStore(spark, target_bytes=target, fanout=4)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghij", k=2000)) for _ in range(400)]
    for i in range(8):
        store.append(frame(spark, texts[50 * i : 50 * i + 50], range(50 * i, 50 * i + 50)).repartition(4))
    small = store.manifest()["shards"]
    now = store.compact()
    sizes = [s["bytes"] for s in now["shards"]]
    assert len(small) == 32 and max(s["bytes"] for s in small) < target // 2
    assert min(sizes) >= target // 2 and max(sizes) <= 2 * target
    assert {r.doc_id: r.text for r in store.read().collect()} == dict(enumerate(texts))


def test_sharding_keeps_the_columns_of_all_arrivals(spark):
    store = sharding.ShardStore(spark, target_bytes=1 << 20, fanout=2)
    store.append(spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, more int").coalesce(1))
    store.append(spark.createDataFrame([(2, "b")], "doc_id long, text string").coalesce(1))
    store.append(spark.createDataFrame([("x", 3)], "late string, doc_id long").coalesce(1))
    for bad in ("doc_id string", "DOC_ID long"):
        with pytest.raises(ValueError, match="the store has"):
            store.append(spark.createDataFrame([], bad))
    want = [(1, "a", 7, None), (2, "b", None, None), (3, None, None, "x")]
    assert sorted(map(tuple, store.read().collect())) == want
    assert len(store.compact()["shards"]) == 1
    store.vacuum()
    assert store.read().columns == ["doc_id", "text", "more", "late"] and sorted(map(tuple, store.read().collect())) == want


def test_sharding_tiers_and_versions(spark):
    store = sharding.ShardStore(spark, target_bytes=1 << 20, fanout=3)
    for i in range(7):
        store.append(odd_frame(spark).where(f"pmod(coalesce(doc_id, 99), 7) = {i}").coalesce(1))
    before = store.manifest()
    assert before["version"] == 7 and len(before["shards"]) == 7
    after = store.compact()
    assert after["version"] > 7 and len(after["shards"]) < 7 and not store.plan(after["shards"])
    assert store.read(7).count() == store.read().count() == odd_frame(spark).count()
    store.vacuum()
    assert store.read().count() == odd_frame(spark).count()
    stale = dict(after, version=after["version"] - 1)
    with pytest.raises(Exception, match="exist"):
        store._commit(stale, [], None)
    empty = sharding.ShardStore(spark)
    empty.append(frame(spark, ["a"]).limit(0))
    assert empty.compact()["version"] == 1 and empty.read().count() == 0


# -- 4 --------------------------------------------------------------------------------------------


def brute_repeats(docs, n):
    """docs: (id, text); id -> (repeated, removed) word places."""
    places = defaultdict(list)
    for i, text in docs:
        words = (text or "").encode().split()
        for s in range(len(words) - n + 1):
            places[tuple(words[s : s + n])].append((i, s))
    again, later, first = defaultdict(set), defaultdict(set), defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for i, s in at:
                again[i] |= set(range(s, s + n))
                (first if (i, s) == min(at) else later)[i].update(range(s, s + n))
    return {i: (again[i], later[i] - first[i]) for i in again}


def spread(spans):
    return {x for s in spans for x in range(s.start, s.end)}


def test_runs_of_sorted_suffixes(spark):
    """However batches and ranges cut the sorted rows."""
    rng = random.Random(2)
    rows = [(rng.randint(0, 60), rng.randint(0, 2), rng.choice([None, *range(20)]), rng.randint(0, 3), rng.randint(0, 5)) for _ in range(400)] + [(7, 1, i, 0, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "prefix long, context long, doc_id long, text_key long, place int")
    want = {}
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        if len(own) > 1:
            first = min((r[2] is None, r[2] or 0, r[3], r[4]) for r in own)
            want[p] = (len(own), min(r[1] for r in own), max(r[1] for r in own), first)
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = suffix_dedup.runs_of(df).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert {r.prefix: (r.copies, r.low, r.high, (r.first.no_id, r.first.doc_id or 0, r.first.text_key, r.first["at"])) for r in got} == want


def check_repeats(df, n, k):
    docs = sorted({(r.doc_id, r.text) for r in df.collect()}, key=str)
    got = {r.doc_id: (spread(r.repeated), spread(r.removed)) for r in suffix_dedup.repeated_passages(df, n, k).collect()}
    assert got == brute_repeats(docs, n)


def test_suffix_dedup_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
            p = rng.choice(shared)
            a = rng.randint(0, 5)
            words += p[a : len(p) - rng.randint(0, 5)]
        texts.append(" ".join(words) if rng.random() < 0.8 else "\n".join(words))
    texts += [texts[0]] * 5 + ["a " * 50, "a b c " * 30]
    check_repeats(frame(spark, texts), 10, 4)
    check_repeats(frame(spark, texts), 12, 12)


def test_suffix_dedup_sample(spark, sf_dir):
    check_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50, 20)


def test_suffix_dedup_filter(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 6) for _ in range(60))
    df = frame(spark, ["clean  text", f"one {passage} end", f"two  {passage}\nother end", passage, ""])
    got = {r.doc_id: r.text for r in suffix_dedup.drop_repeated_passages(df).collect()}
    assert got == {0: "clean  text", 1: f"one {passage} end", 2: "two  other end", 4: ""}


def test_suffix_dedup_odd_rows(spark):
    df = odd_frame(spark)
    got = suffix_dedup.drop_repeated_passages(df)
    assert got.columns == df.columns and got.count() == df.count()
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0


# -- 5 --------------------------------------------------------------------------------------------


def test_langid_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in rows_of(spark, sf_dir)}
    got = queries.op5_langid(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(held) / len(held) > 0.97
    for r in got:
        letters = any(unicodedata.category(c)[0] == "L" for c in docs[r.doc_id].text or "")
        assert letters == (r.lang_pred != "und") and 0 <= r.score <= 1


def test_langid_odd_rows(spark):
    model = langid.fit(frame(spark, ["the and of that with this from", ""]).union(spark.createDataFrame([(9, "der die das und nicht mit", "de", "s", 1), (None, "x", None, None, None)], DOCS)))
    assert set(model) == {"en", "de"}
    got = langid.identify(odd_frame(spark), model).collect()
    assert len(got) == len(ODD) + 3 and [r.lang_pred for r in got if r.doc_id in (0, 1, 2)] == ["und"] * 3
    assert {r.lang_pred for r in langid.identify(odd_frame(spark), {}).collect()} == {"und"}
    assert langid.fit(odd_frame(spark).limit(0)) == {}


# -- 6 --------------------------------------------------------------------------------------------


def brute_segments(scores):
    """Maximal scoring subsequences by their recursive definition."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(sum(scores[x[0] : x[1]]), 9), x[0] - x[1]))
    i, j = best
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_maximal_segments():
    rng = random.Random(0)
    for _ in range(200):
        scores = [rng.choice([-1.0, -1.0, -1.0, 0.7, 1.9, 2.3]) + rng.random() / 1000 * (rng.random() < 2) for _ in range(rng.randint(0, 25))]
        scores = [-1.0 if s < 0 else s for s in scores]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(at, [scores[i] for i in at], 1.0)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)


def test_maximal_segments_take_linear_time():
    """Isolated hits, whose left totals fall: the search for a lower one must not start anew each time."""
    n = 200_000
    start = time.perf_counter()
    assert len(toxicity.maximal_segments(list(range(0, 100 * n, 100)), [1.0] * n, 0.02)) == n
    assert time.perf_counter() - start < 10


def test_significant_segments_add_up():
    assert toxicity.together([5.0]) == 5.0
    assert toxicity.together([5.0, 4.0]) > toxicity.together([5.0, 3.2]) >= 5.0
    model = toxicity.Model({b"bad": (9.0, 3.0)}, lam=1.0, ln_k=-2.0)
    known = toxicity.Weights(model.weights)
    one, two = (toxicity.evidence(b"fine " * 400 + b"bad bad bad bad bad " + b"fine " * 1000 + b"bad bad bad bad bad " * k + b"fine " * 400, model, known) for k in (0, 1))
    assert len(one[1]) == 1 and len(two[1]) == 2 and two[0] > one[0]
    assert toxicity.tokens_of(b"x" * 70)[0] != toxicity.tokens_of(b"x" * 71)[0]


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in rows_of(spark, sf_dir, "labels")}
    got = queries.op6_toxicity(spark, sf_dir).collect()
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    hit = sum(p and t for p, t in held)
    assert hit / sum(p for p, _ in held) > 0.85 and hit / sum(t for _, t in held) > 0.8


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(spark, [("you utter moron " if i % 2 else "a quiet day ") + "in the town" for i in range(400)])
    model = toxicity.fit(docs, labels, F.lit(True))
    assert b"moron" in model.weights and b"town" not in model.weights
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= 0.5) == bool(i % 2) for i in range(400)) and got[1].n_words == 6
    assert toxicity.score(odd_frame(spark), model).where("score < 0.5").count() == len(ODD) + 3
    assert toxicity.fit(docs.limit(0), labels, F.lit(True)).weights == {}


def test_toxicity_words_of_toxic_documents_only(spark):
    """A word of 12 toxic and no clean documents counts, as one of 12 and 1 does; one as frequent in both kinds doesn't."""
    texts, labels = [], []
    for i in range(2000):
        toxic = i < 100
        extra = "vaurien" if i < 12 else "schuft" if i < 24 or i == 500 else "fiend" if toxic else "calm"
        texts.append(f"{extra} {'market' if i % 20 == 0 else 'river'} in the town")
        labels.append((i, int(toxic)))
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert {b"vaurien", b"schuft", b"fiend"} <= set(model.weights) and not {b"market", b"town", b"calm"} & set(model.weights)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), model).collect()}
    assert all(got[i] >= 0.5 for i in range(12)) and all(got[i] < 0.5 for i in range(600, 2000))


# -- 7 --------------------------------------------------------------------------------------------


def brute_license(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]
    found = [(s, label) for phrase, label in license_scan.PHRASES.items() for s in range(len(words)) if words[s : s + len(phrase.split())] == phrase.split()]
    at = [s for s, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op1_chat_format"}))
def test_query_against_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    got, want = both(spark, connection(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
    assert got == want and want


def test_license_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = {r.doc_id: brute_license(r.text) for r in rows_of(spark, sf_dir)}
    got = queries.op7_license_scan(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert any(r.n_base for r in got)


def brute_template_spans(text, min_share=0.7, slack=2):
    """(label, start, end, share) of each template's spans: a diagonal and its neighbours hold enough 2-grams, and no overlapping one holds more."""
    words = [w for w in re.split(license_scan.NOT_WORD, (text or "").translate(LOWER)) if w]
    found = []
    for k, (label, body) in enumerate(license_scan.TEMPLATES):
        t = body.split()
        pairs = {(p - i): set() for i in range(len(t) - 1) for p in range(len(words) - 1) if words[p : p + 2] == t[i : i + 2]}
        for d, held in pairs.items():
            held |= {i for i in range(len(t) - 1) if 0 <= d + i < len(words) - 1 and words[d + i : d + i + 2] == t[i : i + 2]}
        for d in pairs:
            own = [(e + i, i) for e in pairs if abs(e - d) <= slack for i in pairs[e]]
            votes = len({i for _, i in own})
            if votes / (len(t) - 1) >= min_share:
                found.append((k, d, votes, votes / (len(t) - 1), (label, min(own)[0], max(own)[0] + 2, votes / (len(t) - 1)), len(t)))
    out = set()
    for k, d, votes, share, row, size in found:
        if all((votes, -d) >= (v, -e) for j, e, v, *_ in found if j == k and abs(e - d) < size) and all((share, votes, -k) >= (x, v, -j) for j, e, v, x, *_ in found if abs(e - d) <= slack):
            out.add(row)
    return out


def test_license_labels_against_brute_force(spark):
    rng = random.Random(11)
    texts = ["this work " * 12 + license_scan.TEMPLATES[8][1], license_scan.TEMPLATES[7][1] * 2, " ".join([license_scan.TEMPLATES[7][1]] * 3), "", None, "cc by", "this work " * 50]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            own = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.choice([["new"], [], ["license"], own[:2]])
            parts += ["x"] * rng.randint(0, 3) + own
        texts.append(" ".join(parts))
    docs = frame(spark, texts)
    got = defaultdict(set)
    for r in license_scan.scan(docs).where("not phrase").collect():
        got[r.doc_id].add((r.label, r.start, r.end, r.share))
    want = {i: brute_template_spans(t) for i, t in enumerate(texts)}
    assert got == {i: x for i, x in want.items() if x}
    assert {x[0] for x in want[0]} == {"cc-by"} and len(want[2]) == 3
    for r in license_scan.license_report(docs).collect():
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == base | {x[0] for x in want[r.doc_id]}
        assert r.score == max([1.0 if base else 0.0, *[x[3] for x in want[r.doc_id]]])


def test_license_spans(spark):
    mit = license_scan.TEMPLATES[0][1].split()
    texts = [
        "MIT License, mit-license CC BY", " ".join(["x"] * 7 + mit + ["y"]), " ".join(mit[:9] + ["new"] + mit[9:]), " ".join(mit[: len(mit) // 2]),
        "permission to any person of this software", "cc by cc by", None, "cc", "",
    ]
    got = {r.doc_id: r for r in license_scan.license_report(frame(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels) == (3, 0, 4, "cc-by,mit")
    assert got[1].labels == got[2].labels == "mit" and got[1].base_labels == "" and got[1].score == 1.0
    assert got[3].labels == got[4].labels == "" and got[5].n_base == 2
    spans = license_scan.scan(frame(spark, texts)).where("doc_id = 1").collect()
    assert [(s.start, s.end) for s in spans] == [(7, 7 + len(mit))]
    assert (got[6].n_words, got[7].n_words, got[8].n_words) == (0, 1, 0)
    assert license_scan.license_report(odd_frame(spark)).count() == len(ODD) + 3
    assert license_scan.license_report(frame(spark, ["a"]).limit(0)).count() == 0


# -- 8 --------------------------------------------------------------------------------------------


def holds_stretch(equal, least, tenths=8):
    """Whether any stretch of ``least`` places or more has so many tenths of equal ones, by trying all."""
    return any(10 * sum(equal[a:z]) >= tenths * (z - a) for a in range(len(equal)) for z in range(a + least, len(equal) + 1))


def brute_overlap(doc, item, least=13):
    """Whether any stretch of any diagonal has 8 tenths of its words equal; from the definition alone."""
    d, t = ((x or "").translate(LOWER) for x in (doc, item))
    d, t = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", x) for x in (d, t))
    at = defaultdict(list)
    for j, w in enumerate(t):
        at[w].append(j)
    counts = Counter(p - j for p, w in enumerate(d) for j in at.get(w, ()))
    least = min(least, len(t))
    for diagonal, n in counts.items():
        if 10 * n >= 8 * least:
            s, e = max(0, diagonal), min(len(d), diagonal + len(t))
            if holds_stretch([d[i] == t[i - diagonal] for i in range(s, e)], least):
                return True
    return False


def test_decontamination_query(spark, sf_dir):
    items = {r.item_id: r.text for r in rows_of(spark, sf_dir, "benchmark")}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, sf_dir).collect()}
    assert got == {(r.doc_id, i) for r in rows_of(spark, sf_dir) for i, t in items.items() if brute_overlap(r.text, t)}


def test_decontamination_returns_every_passage(spark):
    item = [f"q{j}" for j in range(60)]
    parts = item[:14] + ["gap"] * 30 + item[40:58] + ["gap"] * 5 + item + ["gap"] * 9 + item[:20] + ["other"] * 25 + item[45:]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item))], "item_id long, text string")
    for texts in ([" ".join(parts)], [None, "", " ".join(parts), "gap " * 5000 + " ".join(parts)]):
        rows = decontaminate.overlaps(frame(spark, texts), bench).collect()
        for d, text in enumerate(texts):
            for i in (1, 2) if text else ():
                shift = text.split().index("q0")
                got = sorted((r.doc_start - shift, r.item_start, r.n_words, r.n_equal) for r in rows if (r.doc_id, r.item_id) == (d, i))
                assert got == [(0, 0, 14, 14), (44, 40, 18, 18), (67, 0, 60, 60), (136, 0, 20, 20), (181, 45, 15, 15)]


def test_decontamination_substitutions(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(30)]
    texts, want = [], set()
    for i in range(60):
        copy = list(item)
        for p in rng.sample(range(30), i % 5):
            copy[p] = "other"
        texts.append(" ".join([rng.choice(words) for _ in range(20)] + copy + [rng.choice(words) for _ in range(20)]))
        want.add(i)
    texts += [" ".join(rng.choice(words) for _ in range(200)) for _ in range(40)]
    bench = spark.createDataFrame([(5, " ".join(item)), (6, "tiny item"), (7, None), (8, "")], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.overlaps(frame(spark, texts), bench).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    # blocks of the benchmark give what the whole gives
    blocks = decontaminate.overlaps(frame(spark, texts), bench, block_chars=64).collect()
    assert {r.doc_id for r in blocks} == got
    assert [r.doc_id for r in decontaminate.overlaps(frame(spark, ["a tiny item here", "tiny"]), bench).collect()] == [0]


def test_decontamination_any_stretch():
    rng = random.Random(5)
    for _ in range(600):
        equal = [rng.random() < rng.choice((0.6, 0.75, 0.85)) for _ in range(rng.randint(5, 40))]
        found = decontaminate.similar_stretch(np.array(equal), 13, 0.8)
        assert (found is not None) == holds_stretch(equal, 13), equal
        assert found is None or (found[1] - found[0] >= 13 and 10 * sum(equal[found[0] : found[1]]) >= 8 * (found[1] - found[0]))


def test_decontamination_replaced_words(spark):
    """A replaced word at any place, and half of the words around an exact run, don't hide a passage; nothing else is found."""
    rng = random.Random(4)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((13, 15, 20, 38, 59))]
    texts, want = [], set()
    for k, item in enumerate(items):
        for t in range(60):
            share = (0.0, 0.1, 0.2, 0.25)[t % 4]
            equal = [rng.random() >= share for _ in item]
            if t < len(item):
                equal = [j != t for j in range(len(item))] if k == 0 else equal
            if k == 4 and t >= 30:
                equal = [20 <= j < 34 or rng.random() < 0.5 for j in range(len(item))]
            if holds_stretch(equal, min(13, len(item))):
                want.add((len(texts), k))
            texts.append(" ".join(["before"] * 9 + [w if e else "other" for w, e in zip(item, equal)] + ["after"] * 9))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = decontaminate.overlaps(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and 0 < len(want) < len(texts)
    assert all(r.n_words >= 13 and 10 * r.n_equal >= 8 * r.n_words for r in rows)


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "a b c " * 20), (1, "a b c " * 20)], "item_id long, text string")
    df = odd_frame(spark)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 1
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == df.count()
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0


# -- 9 --------------------------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed


def test_quality_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = {r.doc_id: brute_counts(r.text) for r in rows_of(spark, sf_dir)}
    got = queries.op9_quality(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert not any(r.kept and r.base_failed for r in got) and 0 < sum(r.kept for r in got)


def test_quality_fences_follow_groups(spark):
    rng = random.Random(1)
    body = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(80))
    texts = [body() for _ in range(300)] + [" ".join(f"{x}####{i}" for i, x in enumerate(body().split()))]
    got = {r.doc_id: r for r in quality.judged(frame(spark, texts), ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(300)) and not got[300].kept and not got[300].base_failed


def test_quality_fences_alone_decide(spark):
    """Words of 7 characters are far out in source s and usual in source t; where a source has no repeated lines at all, its language's documents say how many are usual."""
    rng = random.Random(2)
    word = lambda a, z: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(a, z)))
    body = lambda a, z: [" ".join(word(a, z) for _ in range(10)) for _ in range(10)]
    rows = [("s", "\n".join(body(4, 5))) for _ in range(300)] + [("s", "\n".join(body(7, 7)))]
    rows += [("t", "\n".join(body(*((3, 5) if i % 2 else (7, 9))))) for i in range(300)] + [("t", "\n".join(body(7, 7)))]
    rows.append(("s", "\n".join(["a b", *body(4, 5), "a b"])))
    many = lambda: "\n".join(["a b", *body(3, 9), "a b"])
    base = len(rows)
    rows += [("t", many()) for _ in range(250)] + [("t", "\n".join(w.replace(" ", "# ", 4) for w in body(5, 6)))]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(rows)], DOCS)
    got = {r.doc_id: r for r in quality.judged(df, ["doc_id"]).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not got[300].kept and got[300].word_length < got[601].word_length + 1 and got[601].kept
    assert got[602].kept and got[602].dup_line_rate > 0 and all(got[i].kept for i in range(base, base + 250))
    # symbols in four of ten words: nobody else has any
    assert not got[base + 250].kept and got[base + 250].symbol_rate < 0.1
    assert got[300].word_length_most < got[601].word_length_most and got[300].dup_line_rate_most > 0


def brute_kept(rows, spread=4.0, min_group=200):
    """rows: (id, lang, source, text); the verdicts from sorted values, by the definition: quartiles are the values at places ceil(p n)."""
    rates = {}
    for i, _, _, text in rows:
        n, chars, symbols, lines, repeats, failed = brute_counts(text)
        all_lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        per = lambda a, b: a / b if b else 0.0
        rates[i] = None if failed else (per(chars, n), per(symbols, chars), per(lines, len(all_lines)), per(repeats, n))

    def quantiles(keys, column):
        values = sorted(rates[i][column] for i, lang, source, _ in rows if rates[i] and (lang, source)[: len(keys)] == keys)
        at = lambda p: values[max(math.ceil(p * len(values)) - 1, 0)]
        if not values or (keys and len(values) < min_group):
            return None
        return at(0.25), at(0.75), at(0.75) - at(0.25), at(0.9) - at(0.1)

    kept = {}
    for i, lang, source, _ in rows:
        kept[i] = rates[i] is not None
        for c in range(4) if kept[i] else ():
            levels = [quantiles(keys, c) for keys in ((lang, source), (lang,), ())]
            low, high = next((x[0], x[1]) for x in levels if x)
            widths = [x[k] for x, k in ((levels[0], 2), (levels[1], 2), (levels[1], 3), (levels[2], 2), (levels[2], 3)) if x]
            width = next((w for w in widths if w), quality.MIN_WIDTH)
            kept[i] &= rates[i][c] <= high + spread * width and (c > 0 or rates[i][c] >= low - spread * width)
    return kept


def test_quality_kept_against_brute_force(spark):
    """Groups just below, at and above ``min_group``, and one of a language that is too small; all small enough for exact sketches."""
    rng = random.Random(8)
    rows = []
    for lang, source, n, (a, z) in (("en", "p", 60, (3, 5)), ("en", "q", 59, (6, 8)), ("en", None, 61, (2, 9)), ("de", "p", 30, (4, 4)), (None, "q", 70, (3, 7))):
        for k in range(n):
            words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(a, z) + (4 if k % 13 == 0 else 0))) for _ in range(70 if k % 17 else 20)]
            words = [w + "#" * (k % 11 == 0) * rng.randint(0, 3) for w in words]
            lines = [" ".join(words[i : i + 10]) for i in range(0, len(words), 10)]
            rows.append((len(rows), lang, source, "\n".join(lines + lines[:1] * (k % 9 == 0) + lines[:3] * (k % 23 == 0))))
    df = spark.createDataFrame([(i, t, lang, source, len(t)) for i, lang, source, t in rows], DOCS)
    got = {r.doc_id: r.kept for r in quality.judged(df, ["doc_id"], min_group=56).collect()}
    want = brute_kept(rows, min_group=56)
    assert got == want and 20 < sum(not x for x in want.values()) < len(rows) / 2


def test_quality_odd_rows(spark):
    got = quality.judged(odd_frame(spark), ["doc_id"]).collect()
    assert len(got) == len(ODD) + 3 and not any(r.kept for r in got)
    assert quality.judged(frame(spark, ["a"]).limit(0), ["doc_id"]).count() == 0


# -- 10 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in rows_of(spark, sf_dir)}
    for r in queries.op10_bpe(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


def test_bpe_against_library(library):
    enc = bpe.Encoder(queries.vocabulary(), most=500)
    rng = random.Random(7)
    known = [chr(c) for c in range(0x250)]
    texts = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "  \n\n x\t\t", "don't we'LL 's", "x" * 5000, "é́ 漢字 🙂   ²³ ½"]
    texts += ["".join(rng.choice(known) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(0x250, 0xD7FF), rng.randint(32, 126)])) for _ in range(40)) for _ in range(500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = enc.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert enc.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    enc = bpe.Encoder(queries.vocabulary())
    assert all(len(enc.cuts(t)) == 1 for i, t in enc.token.items() if i not in enc.added.values())
    assert len(enc.cuts(b"zqxjkvbq")) > 1


def test_bpe_odd_rows(spark):
    got = bpe.encode_decode(odd_frame(spark), queries.vocabulary()).collect()
    assert len(got) == len(ODD) + 3
    assert all(r.decoded == (ODD[r.doc_id] or "") for r in got if r.doc_id is not None)
