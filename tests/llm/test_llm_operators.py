"""Each operator against a plain version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.llm import ann_graph, chat, secrets
from strandloom.llm._spark import bloom, with_word_count
from strandloom.llm.components import connected_components
from strandloom.llm.curriculum import allocate, curriculum
from strandloom.llm.decontaminate import contaminated, decontaminate
from strandloom.llm.jaccard_join import drop_near_copies, jaccard_classes
from strandloom.llm.line_dedup import LineOptions, dedup_lines
from strandloom.llm.quality import keep_quality, quality_scores
from strandloom.llm.suffix_dedup import RepeatOptions, drop_repeats
from strandloom.llm.suffix_tree_lm import TreeOptions, tree_scores

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, class long, token string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split()
    near = [" ".join(w if rng.random() > p else "zz" for w in words) for p in (0.01, 0.02, 0.02, 0.03, 0.05)]
    passage = prose(rng, 80)
    out = [None, "", " \t\n ", "one", "one two", "one two", "ONE two", base, base, *near]
    out += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    out += ["na " * 500, prose(rng, 6000), "a\nb\nc\nd", "x\nb\nc\ny", "a\nb\nc\nd", "é" * 150 + passage]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "k", i, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_jaccard_components(docs, empty, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = jaccard_classes(docs).collect()
    assert len(got) == len(texts) + 1
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), root[i]) for i in sets}
    assert jaccard_classes(empty).count() == 0
    kept = {r["doc_id"] for r in drop_near_copies(docs).collect()}
    assert kept == {i for i in sets if root[i] == i}


def test_link_counts(spark, monkeypatch):
    from strandloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(11)
    words = prose(rng, 150).split()
    near = [" ".join(w if rng.random() > 0.015 else prose(rng, 1) for w in words) for _ in range(20)]
    rows = list(enumerate([" ".join(words), *near, near[0], prose(rng, 100), "", None]))
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, WORD.findall(lower(t))) for i, t in rows)}
    want = {i: sum(4 * len(a & b) >= 3 * len(a | b) for b in set(sets.values()) - {a}) if a else 0 for i, a in sets.items()}
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and sum(want.values()) > 60


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_bloom_holds_all(spark):
    keep = bloom(spark.range(5000).select((F.col("id") * 7919).alias("k")), "k", 5000)
    assert keep.test(np.arange(5000) * 7919).all()
    assert keep.test(np.arange(5000) * 7919 + 1).mean() < 0.1


@pytest.mark.parametrize("hot", [1, 50_000])
def test_repeats(docs, empty, texts, hot):
    rows = [*texts, texts[7]]
    seen = collections.Counter()
    for t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    got = {r["key"]["doc_id"]: r for r in drop_repeats(docs, options=RepeatOptions(hot=hot, salts=3)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        drop = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                drop[k : k + 200] = True
        kept = bytes(x for x, d in zip(b, drop, strict=True) if not d)
        edges = np.diff(np.concatenate(([0], drop.astype(int))))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), int(drop.sum()), int((edges == 1).sum()), kept)
    assert drop_repeats(empty).count() == 0


def test_lines(docs, empty, texts):
    first, gone = {}, collections.defaultdict(set)
    for i, t in enumerate(texts):
        if t is None:
            continue
        lines = t.split("\n")
        for k in range(len(lines) - 1):
            if first.setdefault(tuple(lines[k : k + 2]), (i, k)) != (i, k):
                gone[i] |= {k, k + 1}
    for r in dedup_lines(docs).collect():
        t = texts[r["key"]["doc_id"]]
        if t is None:
            assert r["text"] is None and r["n_lines"] == 0
        else:
            cut = gone[r["key"]["doc_id"]]
            assert r["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
            assert (r["n_lines"], r["n_removed"]) == (len(t.split("\n")), len(cut))
    assert dedup_lines(empty).count() == 0


def test_long_lines(spark, docs, texts):
    import corpus_pipeline

    first, seen, gone = {}, {}, collections.defaultdict(set)
    for i, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        for k in range(len(lines)):
            if len(WORD.findall(lines[k])) >= 50 and seen.setdefault(lines[k], (i, k)) != (i, k):
                gone[i] |= {k}
            if k + 1 < len(lines) and first.setdefault(tuple(lines[k : k + 2]), (i, k)) != (i, k):
                gone[i] |= {k, k + 1}
    assert gone[8] == {0} and gone[15] >= {1}
    for r in dedup_lines(docs, options=LineOptions(long_line=50)).where("text is not null").collect():
        i = r["key"]["doc_id"]
        assert r["n_removed"] == len(gone[i]) and r["text"] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone[i])
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert 8 not in kept and texts[15].split("\n")[1] not in kept[15].split("\n")


def test_contamination(spark, docs, empty, texts):
    long = texts[20].split()
    items = [(1, " ".join(texts[7].upper().split()[10:60])), (2, " ".join(long[:20] + ["q"] * 3)), (3, "one two"), (4, None), (5, ""), (6, " ".join(long[100:112])), (6, " ".join(long[100:112]))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(t):
        w = WORD.findall(lower(t))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {(i, j) for i, t in enumerate(texts) for j, q in items if grams(q) and 4 * len(grams(q) & grams(t)) >= 3 * len(grams(q))}
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == want and want
    bad = {i for i, _ in want}
    assert {r["doc_id"] for r in decontaminate(docs, bench).collect()} == {i for i in range(len(texts)) if i not in bad}
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_mix(docs, empty):
    got = allocate(docs).collect()
    total = sum(r["mix_size"] for r in got)
    for r in got:
        assert r["mix_size"] == len(WORD.findall(r["key"]["text"] or "")) and 0 <= r["mix_taken"] <= 2 * r["mix_size"]
    by = collections.defaultdict(list)
    for r in got:
        by[r["key"]["source"]].append(r)
    assert abs(sum(rows[0]["mix_target"] for rows in by.values()) - 1.5 * total) < 1e-6
    for rows in by.values():
        assert sum(r["mix_taken"] for r in rows) == math.floor(rows[0]["mix_target"]) and rows[0]["mix_target"] <= 2 * rows[0]["mix_source_size"]
    order = curriculum(docs).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert sum(r["words"] for r in order) == sum(r["mix_taken"] for r in got)
    assert curriculum(empty).count() == 0


def test_word_count(docs):
    for r in with_word_count(docs, "text", "n").collect():
        assert r["n"] == len(WORD.findall(r["text"] or ""))


def test_tree_base_and_gain(spark, docs, empty, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    count = collections.Counter()
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    for r in tree_scores(docs).collect():
        t = tokens[r["doc_id"]]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert r["train_tokens"] == n and r["n_tokens"] == len(t) and r["n_known"] == sum(count[x] > 0 for x in t)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    assert tree_scores(empty).count() == 0
    rng = random.Random(1)
    pairs = spark.createDataFrame([(i, " ".join(rng.choice(("alpha beta", "gamma delta")) for _ in range(200))) for i in range(200)], "doc_id long, text string")
    held = tree_scores(pairs, options=TreeOptions(least=2)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] + 100


def test_tree_keeps_rare_strings_of_large_corpora(spark):
    """Nine occurrences count among twelve million words as among few; also where strings are joined, not held."""
    many = spark.range(1, 61).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', 250000)").alias("text"))
    few = spark.createDataFrame([(i, "p q") for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10][:9], "doc_id long, text string")
    held = next(i for i in range(2000, 2400) if zlib.crc32(str(i).encode()) % 10 == 0)
    last = spark.createDataFrame([(held, "p q")], "doc_id long, text string")
    got = tree_scores(many.unionAll(few).unionAll(last)).where(F.col("doc_id") == held).first()
    assert got["held_out"] and got["train_tokens"] > 8_000_000
    # both q after p and the end after q have 8.5 of 9
    n, v = got["train_tokens"], 4
    ends = 9 + sum(zlib.crc32(str(i).encode()) % 10 > 0 for i in range(1, 61))
    root = [math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in (9, 9, ends)]
    assert abs(got["base_score"] - sum(root)) < 1e-6 and abs(got["score"] - root[0] - 2 * math.log10(8.5 / 9)) < 1e-6


def test_quality_separates(spark, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, 200) if i % 2 else "BUY!! " * rng.randint(20, 200)) for i in range(400)] + [(400, ""), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in keep_quality(docs, labels).collect()} >= set(range(1, 400, 2))
    assert quality_scores(docs, labels.limit(0)).count() == 402 and quality_scores(empty, labels).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[INST]", "x</s>"]), st.text(alphabet="<>[]/\\sINTab\n", max_size=30) | st.sampled_from(["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]"])), max_size=5))
def test_chat_round_trip(turns):
    back = chat.parse(chat.render(turns))
    assert [(x.role, x.text) for x in back] == turns


def test_chat_table(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", None), (2, 1, None, ""), (2, 1, None, ""), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got[1]["loss_text"] == "b</s>" and [t["text"] for t in got[1]["turns"]] == ["", "b</s>"]
    assert len(got[2]["turns"]) == 2 and got[None]["loss_text"] == ""
    assert chat.format_chats(df.limit(0)).count() == 0


def test_secrets():
    key = "AKIA" + "ABCDEFGH12345678"
    text = f'é password="{"a1" * 8}" {key} token=short 0123456789abcdef x{"q" * 30} Zx9+Kd83jLmQ0pT7vBnR4yWs'
    found = secrets.scan(text)
    assert [k for k, _, _ in found] == ["assign", "hex", "access", "hex", "entropy"]
    assert text[found[2][1] : found[2][2]] == key
    assert secrets.scan("") == [] and secrets.scan("see https://example.org/some/long/path-with-words-only/index") == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdef0123456789XYZ ", min_size=0, max_size=60))
def test_window_entropy_is_incremental(text):
    kind = secrets.CLASSES[0]
    best = -1.0
    for i in range(len(text) - kind.width + 1):
        w = text[i : i + kind.width]
        if all(c in kind.members for c in w):
            best = max(best, -sum(k / kind.width * math.log2(k / kind.width) for k in collections.Counter(w).values()))
    assert abs(secrets.window_entropy(text, kind) - best) < 1e-9


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[10:60] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann_graph.nearest_neighbours(df, lambda i: i % 100 == 0, options=ann_graph.GraphOptions(shard=500)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hits = total = 0
    wide = x.astype(float)
    for q in range(0, 1500, 100):
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = sorted(zip(far, range(1500), strict=True))[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q]) and all(abs(far[i] - s) < 1e-12 for s, i in got[q])
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        total += 10
    assert hits / total >= 0.9 and set(got) == set(range(0, 1500, 100))
    assert ann_graph.nearest_neighbours(df.limit(0), lambda i: i % 100 == 0).count() == 0


@pytest.mark.parametrize("name", ["op4_chat_format", "op6_decontaminate", "op7_line_dedup", "op8_jaccard_join", "op9_suffix_dedup", "op10_curriculum_mix"])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = [sorted(map(str, f[order].astype({c: float for c in order if f[c].dtype.kind in "iuf"}).round(9).itertuples(index=False))) for f in (got, want)]
    assert rows[0] == rows[1]


def test_digest_of_kept_bytes(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op9_suffix_dedup"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if got[r["doc_id"]]["n_removed"] == 0:
            assert got[r["doc_id"]]["kept_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_null_ids(spark):
    rows = [(None, "a b c d e f g\nh i j k l m n"), (None, None), (1, "a b c d e f g\nh i j k l m n"), (2, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "a b c d e f g"), (5, "h i j k l m n")], "item_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_classes(df).collect()} == {(None, 1), (None, None), (1, 1), (2, 2)}
    assert sorted(r['doc_id'] or 0 for r in drop_near_copies(df).collect()) == [0, 1, 2]  # the null id's copy of 1 goes, the null text stays
    got = {r["key"]["doc_id"]: r["n_removed"] for r in dedup_lines(df).where("text is not null").collect()}
    assert got == {None: 0, 1: 2, 2: 0}
    assert {r["n_removed"] for r in drop_repeats(df).collect()} == {0}
    assert {r["item_id"] for r in contaminated(df, bench).collect()} == {None, 5} and decontaminate(df, bench).count() == 2
    assert sum(r["mix_taken"] for r in allocate(df).collect()) == math.floor(1.5 * 31) and curriculum(df).count() > 0
    assert quality_scores(df, labels).count() == 4 and tree_scores(df).count() == 4
    from strandloom.llm.secrets import find_secrets

    assert find_secrets(df).count() == 4
