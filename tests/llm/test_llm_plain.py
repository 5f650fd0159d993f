"""Scores, scans and the pipeline against plain versions written from their definitions; clashing columns and hard inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.llm import ann_graph, chat
from strandloom.llm._spark import settle
from strandloom.llm.curriculum import allocate, curriculum
from strandloom.llm.decontaminate import candidates, contaminated, decontaminate, item_shingles
from strandloom.llm.jaccard_join import drop_near_copies, jaccard_classes
from strandloom.llm.line_dedup import dedup_lines
from strandloom.llm.quality import DiscriminantOptions, keep_quality, quality_scores
from strandloom.llm.secrets import find_secrets, scan
from strandloom.llm.suffix_dedup import RepeatOptions, drop_repeats
from strandloom.llm.suffix_tree_lm import TreeOptions, tree_scores

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def crc(i):
    return zlib.crc32(str(i).encode())


# --- quality -------------------------------------------------------------------------------------------------------


def plain_statistics(text):
    words = [w.encode() for w in WORD.findall(text or "")]
    n, size = len(words), [len(w) for w in words]
    raw = b"".join(words)
    mean = sum(size) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in size) / max(n, 1) - mean**2, 0))
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    most = max(collections.Counter(low).values(), default=0)

    def odds(k, of):
        return math.log((k + 0.5) / (max(of - k, 0) + 0.5))

    kinds = [sum(65 <= b <= 90 for b in raw), sum(48 <= b <= 57 for b in raw), sum(b in b".,;:?" for b in raw)]
    kinds += [sum(33 <= b < 127 and not chr(b).isalnum() and b not in b".,;:?" for b in raw), sum(b >= 128 for b in raw)]
    parts = [len(set(low)), sum(a == b for a, b in zip(low, low[1:], strict=False)), most, sum(x <= 3 for x in size), sum(x > 12 for x in size)]
    parts += [sum(w[-1] in b".,;:?" for w in words), sum(65 <= w[0] <= 90 for w in words)]
    lines = (text or "").count("\n") + 1
    return [math.log1p(n), math.log1p(mean), math.log1p(spread), *(odds(k, sum(size)) for k in kinds), *(odds(k, n) for k in parts), math.log(lines / (n + 1))]


def plain_quality(texts, labels, o=DiscriminantOptions()):
    """{id: score} by densities of two normal distributions with shrunk covariances."""
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    classes = [np.array([x[i] for i, q in labels if q == k and i in x and crc(i) % 5]) for k in (0, 1)]
    n = [len(c) for c in classes]
    within = [(c - c.mean(axis=0)).T @ (c - c.mean(axis=0)) for c in classes]
    pooled = (within[0] + within[1]) / (sum(n) - 2) + np.eye(16) * 1e-6
    density = []
    for k in (0, 1):
        part = max(o.shrink, min(1.0, 32 / (n[k] + 1)))
        cov = (1 - part) * within[k] / (n[k] - 1) + part * pooled + o.floor * np.diag(np.diag(pooled))
        density.append((classes[k].mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], math.log((n[k] + 1) / (sum(n) + 2))))
    out = {}
    for i, v in x.items():
        log = [o.temper * -0.5 * ((v - m) @ inv @ (v - m) + det) + prior for m, inv, det, prior in density]
        out[i] = 1 / (1 + math.exp(log[0] - log[1])) if log[0] - log[1] < 700 else 0.0
    return out


def test_quality_equals_plain_discriminant(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_quality({r["doc_id"]: r["text"] for r in docs.collect()}, [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-7 for r in got)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(rows) > 500 and right >= 0.98 and np.mean([g > b for g in good for b in bad]) >= 0.99


# --- language model ------------------------------------------------------------------------------------------------


class PlainTree:
    def __init__(self, texts, o):
        self.o, strings = o, collections.Counter()
        for t in texts:
            for k in range(o.depth + 1):
                strings.update(tuple(t[i : i + k + 1]) for i in range(len(t) - k))
        self.n = sum(c for s, c in strings.items() if len(s) == 1)
        self.den = self.n + 0.1 * (sum(len(s) == 1 for s in strings) + 1)
        self.count = {s: c for s, c in strings.items() if c >= o.least}
        self.seen = {s[0]: c for s, c in strings.items() if len(s) == 1}
        self.skip, nexts = {}, collections.defaultdict(list)
        for s in self.count:
            nexts[s[:-1]].append(s[-1])
        for s in sorted((s for s in nexts if s), key=len):
            p = {w: (self.count[(*s, w)] - o.discount) / self.count[s] for w in nexts[s]}
            parent = {w: self.prob(s[1:], w) for w in p}
            rest, rest_parent = (max(1 - sum(x.values()), 1e-12) for x in (p, parent))
            kl = sum(p[w] * math.log(p[w] / parent[w]) for w in p) + rest * math.log(rest / rest_parent)
            if self.count[s] * kl >= 0.5 * len(p) * math.log(self.n):
                self.skip[s] = rest / rest_parent

    def prob(self, context, word):
        if not context:
            return (self.seen.get(word, 0) + 0.1) / self.den
        if context not in self.skip:
            return self.prob(context[1:], word)
        if (*context, word) in self.count:
            return (self.count[(*context, word)] - self.o.discount) / self.count[context]
        return self.skip[context] * self.prob(context[1:], word)

    def score(self, t):
        return sum(math.log10(self.prob(tuple(t[max(0, i - self.o.depth) : i]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("depth,least", [(3, 3), (2, 8), (1, 2)])
def test_tree_equals_plain_tree(spark, depth, least):
    rng = random.Random(depth)
    chains = {w: [rng.choice("abcdefgh") for _ in range(3)] for w in (x + y for x in "abcdefgh" for y in "abcdefgh")}
    texts = {}
    for i in range(150):
        t = [rng.choice("abcdefgh"), rng.choice("abcdefgh")]
        for _ in range(rng.randint(0, 120)):
            t.append(rng.choice(chains[t[-2][0] + t[-1][0]]) if rng.random() < 0.9 else rng.choice("abcdefgh") * rng.randint(1, 3))
        texts[i] = " ".join(t[: len(t) if i % 9 else i % 4])
    texts[150], texts[151] = None, ""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    options = TreeOptions(depth=depth, least=least)
    tokens = {i: [*WORD.findall(lower(t)), ""] for i, t in texts.items()}
    tree = PlainTree([t for i, t in tokens.items() if crc(i) % 10], options)
    got = {r["doc_id"]: r["score"] for r in tree_scores(df, options=options).collect()}
    assert tree.skip and set(got) == set(texts)
    assert all(abs(got[i] - tree.score(t)) < 1e-8 * max(1, abs(got[i])) for i, t in tokens.items())


# --- secrets -------------------------------------------------------------------------------------------------------


def plain_base(text):
    out = []
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in pattern.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def test_secret_query_equals_plain_scan(spark):
    rows = entry.queries()["op5_secret_scan"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        for kind in ("assign", "access", "hex"):
            assert r[f"n_{kind}"] == sum(x.startswith(kind + ":") for x in base)
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("entropy:")] == base


def test_secrets_of_hard_rows(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    long = "word " * 20_000 + "token=" + "z9" * 10 + " " + "AKIA" + "Q7" * 9 + " pre-" + "0a1b" * 5 + "-2024 " + key
    rows = [(1, long, "x"), (1, long, "x"), (2, None, "y"), (3, "", None), (None, "é" + key, "z")]
    got = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, findings string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append([tuple(x) for x in r["findings"]])
    assert by[1][0] == by[1][1] == scan(long) and by[2] == by[3] == [[]]
    assert [f"{k}:{a}:{b}" for k, a, b in by[1][0] if k != "entropy"] == plain_base(long)
    assert by[None] == [[("entropy", 1, 41)]] and ("entropy", len(long) - 40, len(long)) in by[1][0]
    assert not any(k == "entropy" for k, _, _ in scan("a-long-slug-with-2024-words/and-parts_of_words/12 " * 3))
    assert find_secrets(spark.createDataFrame(rows, "doc_id long, text string, findings string").limit(0)).count() == 0


# --- the pipeline --------------------------------------------------------------------------------------------------


def plain_lines(texts):
    first, seen, out = {}, {}, {}
    for i in sorted(texts):
        lines, gone = texts[i].split("\n"), set()
        for k, line in enumerate(lines):
            if len(WORD.findall(line)) >= 50 and seen.setdefault(line, (i, k)) != (i, k):
                gone.add(k)
            if k + 1 < len(lines) and first.setdefault(tuple(lines[k : k + 2]), (i, k)) != (i, k):
                gone |= {k, k + 1}
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if text or not gone:
            out[i] = text
    return out


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_groups(texts):
    sets, kept = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                low, high = sorted((kept[a], kept[b]))
                kept = {k: low if v == high else v for k, v in kept.items()}
    return {i: t for i, t in texts.items() if kept[i] == i}


def plain_clean(texts, items):
    grams = [g for g in (shingles(t) if len(WORD.findall(t)) >= 5 else set() for t in items) if g]
    own = {i: shingles(t) if len(WORD.findall(t)) >= 5 else set() for i, t in texts.items()}
    return {i: t for i, t in texts.items() if not any(4 * len(g & own[i]) >= 3 * len(g) for g in grams)}


def plain_mix(texts, sources):
    """{(id, pass): (words, position)}."""
    size, of = {i: len(WORD.findall(t)) for i, t in texts.items()}, collections.defaultdict(list)
    for i in texts:
        of[sources[i]].append(i)
    names = sorted(of, key=lambda s: (s is None, s))
    weight, whole = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {s: sum(size[i] for i in of[s]) for s in names}
    total, target, full = 1.5 * sum(size.values()), {}, set()
    while True:
        rest = total - sum(2 * whole[s] for s in full)
        target = {s: 2 * whole[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] >= 2 * whole[s]}
        if not over:
            break
        full |= over
    knots = (((0, 1.5), (1, 0.5)), ((0, 1), (1, 1)), ((0, 0.25), (0.5, 1), (1, 1.75)))

    def area(t, line):
        return sum((min(t, b) - a) * (v + (v + (w - v) * (min(t, b) - a) / (b - a))) / 2 for (a, v), (b, w) in zip(line, line[1:], strict=False) if t > a)

    out = {}
    for k, s in enumerate(names):
        at, budget, line = 0, math.floor(target[s]), knots[k % 3]
        for p in (0, 1):
            for i in sorted(of[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
                if (words := min(size[i], budget - at)) > 0:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        mid = (low + high) / 2
                        low, high = (mid, high) if area(mid, line) < area(1, line) * at / target[s] else (low, mid)
                    out[i, p] = (words, high)
                at += size[i]
    return out


def test_pipeline_equals_plain_stages(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = plain_quality({i: r["text"] for i, r in docs.items()}, labels)
    texts = {i: r["text"] for i, r in docs.items() if scores[i] >= 0.3}
    sizes = [len(texts)]
    for stage in (plain_lines, plain_groups, lambda t: plain_clean(t, items)):
        texts = stage(texts)
        sizes.append(len(texts))
    want = plain_mix(texts, {i: r["source"] for i, r in docs.items()})
    got = entry.queries()["pipeline"](spark, SF).collect()
    assert len(docs) > sizes[0] > sizes[2] > sizes[3] and len(got) == len(want)
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    for r in got:
        words, position = want[r["doc_id"], r["pass"]]
        assert (r["text"], r["words"], r["source"], r["lang"]) == (texts[r["doc_id"]], words, docs[r["doc_id"]]["source"], docs[r["doc_id"]]["lang"])
        assert abs(r["position"] - position) < 1e-9 and r["n_chars"] == (len(r["text"]) if r["text"] != docs[r["doc_id"]]["text"] else docs[r["doc_id"]]["n_chars"])


# --- clashing columns, repeats, long texts -------------------------------------------------------------------------

CLASH = ("row_key", "before", "part", "src", "position", "pass", "words", "words_", "mix_size", "key", "k", "h", "d", "score", "class", "token", "hot", "salt", "row", "id", "mark", "findings")


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(90))
    texts = [passage, passage + " more", None, "", "x " * 30, "new\nline " + passage, passage, " ".join(f"w{rng.random()}" for _ in range(20_000))]
    rows = [(i, t, "s", *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)] + [(0, texts[0], "s", *[f"{c}0" for c in CLASH])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


def test_clashing_columns(spark, clashing):
    names, bare = clashing.columns, clashing.select("doc_id", "text", "source")
    bench = spark.createDataFrame([(1, "x x x x x x", "a")], "item_id long, text string, h string")
    labels = spark.createDataFrame([(i, i % 2, "a") for i in range(8)], "doc_id long, quality int, x string")

    def rows(df):
        return sorted(str(tuple(r)) for r in df.collect())

    for stage in (lambda d: decontaminate(d, bench), drop_near_copies, lambda d: keep_quality(d, labels)):
        got = stage(clashing)
        assert got.columns == names and rows(got.select("doc_id", "text", "source")) == rows(stage(bare))
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in CLASH)
    mixed = curriculum(clashing)
    assert mixed.columns == [*names, "pass_", "words__", "position_"]
    assert rows(mixed.select("doc_id", "pass_", "words__", "position_")) == rows(curriculum(bare).select("doc_id", "pass", "words", "position"))
    assert all(r["part"] == f"part{r['doc_id']}" and r["pass"] == f"pass{r['doc_id']}" for r in mixed.collect())
    for make in (allocate, dedup_lines, drop_repeats):
        got = make(clashing)
        assert got.select("key.row_key", "key.part").columns == ["row_key", "part"] and got.count() == 9
        assert rows(got.drop("key")) == rows(make(bare).drop("key"))
    for make in (lambda d: jaccard_classes(d), tree_scores, lambda d: quality_scores(d, labels), lambda d: contaminated(d, bench), find_secrets):
        assert rows(make(clashing)) == rows(make(bare)) and make(bare).count() > 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(map(str, range(40)))
    rows = [(5, text, 0), (5, text, 1), (5, "other text of the same id", 2), (7, text + " x", 3), (None, text, 4), (None, "alone of the nulls here", 5), (None, None, 6)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(5, text), (5, rows[2][1]), (0, rows[5][1]), (0, "")])


def test_sketch_asks_for_fewer_pairs_than_all_shingles(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    items = spark.createDataFrame([(1, " ".join(words[:60])), (2, " ".join(words[60:]))], "item_id long, text string")
    docs = [(i, " ".join([*(f"v{rng.randint(0, 9999)}" for _ in range(50)), *words[i : i + 8]])) for i in range(100)] + [(200, " ".join(words[:55]))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    shingled = settle(item_shingles(items))
    asked = candidates(rows.select(F.struct("doc_id", F.lit(0).alias("row_key")).alias("d"), "text"), shingled).select("d.doc_id", "item_id").collect()
    grams = [{tuple(words[a + k : a + k + 5]) for k in range(56)} for a in (0, 60)]
    sharing = {(i, j + 1) for i, t in docs for j, g in enumerate(grams) if shingles(t) & g}
    assert {(200, 1)} <= {tuple(r) for r in asked} < sharing and len(asked) < len(sharing) / 4
    assert [(r["doc_id"], r["item_id"], r["n_shared"]) for r in contaminated(rows, items).collect()] == [(200, 1, 51)]


def test_repeats_of_long_texts_in_pieces(spark):
    rng = random.Random(8)
    body = "".join(rng.choice("abcd") for _ in range(5000))
    texts = {1: body, 2: "q" * 100 + body[1900:2500] + "r" * 50, 3: body[:300] + "s" + body[4700:]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole, pieces = (sorted((r["key"]["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in drop_repeats(df, options=o).collect()) for o in (RepeatOptions(), RepeatOptions(piece=700)))
    assert whole == pieces and [x[1:3] for x in whole] == [(1200, 3), (600, 1), (600, 2)]


def test_neighbours_of_extreme_and_repeated_vectors(spark):
    rng = np.random.default_rng(1)
    small = rng.normal(size=(60, 8))
    for factor in (1e20, 1e-20, 1e200):
        rows = [(i, (v * factor).tolist()) for i, v in enumerate(small)]
        got = ann_graph.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, options=ann_graph.GraphOptions(shard=20, block=2, blocks=1)).collect()
        for q in (0, 20, 40):
            far = np.sqrt(((small - small[q]) ** 2).sum(axis=1))
            far[q] = np.inf
            found = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
            assert [i for _, i in found] == np.argsort(far)[:10].tolist()
    # equal vectors in all shards, repeated ids, extra columns
    rows = [(i, [1.0, 2.0], "x") for i in range(40)] + [(3, [1.0, 2.0], "y"), (41, [5.0, 2.0], None)]
    got = ann_graph.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string"), lambda i: i == 0, options=ann_graph.GraphOptions(shard=10)).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i, 0.0) for i in range(1, 11)]


def test_recall_over_shards_of_full_size(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in ann_graph.nearest_neighbours(df, lambda i: i % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    wide, hits = x.astype(float), 0
    for q in range(0, 9000, 100):
        far = ((wide - wide[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & got[q])
    assert hits / 900 >= 0.9


def test_chat_of_long_texts_and_extra_columns(spark):
    long = "</s>[INST] " * 20_000
    rows = [(1, 1, "user", long, "a"), (1, 2, "assistant", long, "b"), (1, 2, "assistant", long, "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.read_back(chat.format_chats(df)).collect()
    assert len(got) == 1 and got[0]["loss_text"] == long + long and [t["text"] for t in got[0]["turns"]] == [long] * 3
