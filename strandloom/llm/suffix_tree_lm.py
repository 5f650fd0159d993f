"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._keys import Held, columns, decode, dense, encode, key_counts, least_count, pieces, range_bits, sparse, starts
from ._spark import Bloom, bloom, discard, store
from ._text import chunks, mix, word_hashes

_U = np.uint64
#: The token that ends each text.
END = _U(0x7F4A7C159E3779B9)
#: Words whose counts every task holds: the most common ones, at most this many. Counts of others are joined.
HELD_WORDS = 1 << 21
#: Least count of a held word; so that the part of a corpus that is joined is alike at every size.
HELD_COUNT = 4
#: The same for strings of the tree: from this count on, at most so many; rarer ones are joined.
HELD_STRINGS = 1 << 20
HELD_STRING_COUNT = 32
#: Strings that a task sorts together before they leave it.
FLUSH = 1 << 20
#: Words, and texts, that are scored together: what they need of the joined part goes in one block for each range.
GROUP_WORDS, GROUP_TEXTS = 1 << 21, 1 << 15


@dataclass(frozen=True)
class TreeOptions:
    """depth: words of the longest context; least: least count of a string (context and next word), at every
    size of the corpus; discount: taken off each kept count for words not kept."""

    depth: int = 3
    least: int = 8
    discount: float = 0.5


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, document): words in lower case, and the end after each document's last."""
    value, doc, first = word_hashes(data, bounds)
    docs = len(bounds) - 1
    at = first[1:] + np.arange(docs)
    out, of = np.empty(len(value) + docs, np.uint64), np.empty(len(value) + docs, np.int64)
    mask = np.ones(len(out), bool)
    mask[at] = False
    out[mask], of[mask], out[at], of[at] = value, doc, END, np.arange(docs)
    return out, of


def _join(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of a context with one more word."""
    return mix(context * _U(0x9E3779B97F4A7C15) + token)


def _endings(token: np.ndarray, doc: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for k < size the hashes of the k + 1 words that end at each position, the position's number in its text).

    A hash stands for words of one text where that number is k or more.
    """
    n = len(token)
    ends = [token]
    for k in range(1, size):
        longer = np.zeros(n, np.uint64)
        longer[k:] = _join(ends[k - 1][k - 1 : n - 1], token[k:])
        ends.append(longer)
    return ends, np.arange(n) - np.searchsorted(doc, doc)


def _words(batch):
    for _, _, data, bounds in chunks(batch.column(0)):
        yield _tokens(data, bounds)[0]


def _counted(texts: DataFrame, size: int, bits: int, words_var, frequent_var, least: int) -> DataFrame:
    """(context, token, key, c) of the strings of a context of ``size`` words and a next word with the least count.

    A string that is frequent has frequent parts, so others aren't counted. A task counts a few
    million strings at a time; what leaves it are blocks of contexts, each with its next words, for
    each range of contexts, which is merged in one task. A next word that all tasks hold goes as its number.
    """

    def fill(batches):
        held: list[np.ndarray] = []
        many = 0
        words = words_var.value

        def flush():
            context, token = np.concatenate(held, axis=1)
            held.clear()
            order = np.argsort((context & _U(0xFFFFFFFFFF000000)) | (token >> _U(40)))
            context, token = context[order], token[order]
            first = np.union1d(starts(context), starts(token))
            count = np.diff(np.concatenate((first, [len(token)])))
            context, token = context[first], token[first]
            number, known = words.find(token)
            rows = []
            for is_held in (True, False):
                pick = np.flatnonzero(known == is_held)
                of, next_word, times = context[pick], number[pick].astype(np.uint32) if is_held else token[pick], count[pick]
                for part, lo, hi in pieces((of >> _U(64 - bits)).astype(np.int64)):
                    run = starts(of[lo:hi])
                    lengths = np.diff(np.concatenate((run, [hi - lo]))).astype(np.uint32)
                    coded = next_word[lo:hi].view(np.uint8).reshape(hi - lo, -1)[:, : 3 if is_held else 8]
                    rows.append((part, is_held, of[lo:hi][run].tobytes(), lengths.tobytes(), coded.tobytes(), sparse(times[lo:hi])))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), *[pa.binary()] * 4), strict=True)], ["part", "held", "contexts", "runs", "tokens", "many"])

        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                token, doc = _tokens(data, bounds)
                ends, place = _endings(token, doc, size)
                good = frequent_var.value.test(ends[-1]) & (place >= size - 1)
                # the string's last ``size`` words are frequent too
                at = np.flatnonzero(good[:-1] & good[1:] & (place[1:] >= size)) + 1
                held.append(np.stack([ends[-1][at - 1], token[at]]))
                many += len(at)
                if many >= FLUSH:
                    yield flush()
                    many = 0
        if many:
            yield flush()

    def merge(key, group):
        names = words_var.value.keys
        context, token, count = [], [], []
        for is_held, of, run, next_word, times in zip(*(group.column(c) for c in ("held", "contexts", "runs", "tokens", "many")), strict=True):
            context.append(np.repeat(np.frombuffer(of.as_buffer(), _U), np.frombuffer(run.as_buffer(), np.uint32)))
            n = len(context[-1])
            coded = np.frombuffer(next_word.as_buffer(), np.uint8).reshape(n, -1)
            if is_held.as_py():
                number = np.zeros((n, 4), np.uint8)
                number[:, :3] = coded
                token.append(names[number.view(np.uint32).ravel()])
            else:
                token.append(np.ascontiguousarray(coded).view(_U).ravel())
            count.append(dense(times.as_buffer(), n))
        context, token, count = np.concatenate(context), np.concatenate(token), np.concatenate(count)
        string = _join(context, token)
        order = np.argsort(string)
        first = starts(string[order])
        total = np.add.reduceat(count[order], first)
        good = total >= least
        pick = order[first[good]]
        return pa.table({"context": context[pick].view(np.int64), "token": token[pick].view(np.int64), "key": string[pick].view(np.int64), "c": total[good]})

    return texts.mapInArrow(fill, "part long, held boolean, contexts binary, runs binary, tokens binary, many binary").groupBy("part").applyInArrow(merge, "context long, token long, key long, c long")


def _suffixed(batches):
    """Adds the hash of each string without its first word."""
    for batch in batches:
        token, shorter = (batch.column(x).to_numpy(zero_copy_only=False).view(_U) for x in ("token", "shorter"))
        one = batch.column("one").to_numpy(zero_copy_only=False)
        suffix = np.where(one, token, _join(shorter, token))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("context", "token", "c", "total", "key")), pa.array(suffix.view(np.int64))], ["context", "token", "c", "total", "key", "suffix"])


def grow(words: DataFrame, level: DataFrame, shorter: DataFrame | None, den: float, n: int, options: TreeOptions) -> tuple[DataFrame, DataFrame]:
    """Retains the contexts whose next-word distribution diverges from their suffix's.

    A context s with count c passes if c KL(P(.|s) || P(.|suffix)) is at least half its kept words times
    ln N; words not kept are one more outcome. Its suffix is the longest retained one.
    Kept words have their count less the discount; the rest of the mass goes to the
    other words in proportion to the suffix's distribution.

    words, level and shorter hold the frequent words and strings of this and the level before. Gives the
    strings with ``ratio``, log10 of their last word's probability over the root's, and ``weight``, what a
    kept string adds to its context's weight and the shorter string's ratio; and the contexts with
    ``weight``, the factor of a next word not kept. So a text's score is a sum of weights.
    """
    level = level.join(words.select("token", ((F.col("c") + 0.1) / F.lit(den)).alias("root")), "token")
    if shorter is None:
        level = level.withColumn("v", F.lit(0.0))
    else:
        level = level.join(shorter.select(F.col("key").alias("suffix"), F.col("ratio").alias("v")), "suffix")
    level = level.withColumn("p", (F.col("c") - options.discount) / F.col("total")).withColumn("parent", F.col("root") * F.pow(F.lit(10.0), "v"))
    each = level.groupBy("context").agg(F.sum("p").alias("p"), F.sum("parent").alias("parent"), F.sum(F.col("p") * F.log(F.col("p") / F.col("parent"))).alias("kl"), F.count("*").alias("size"), F.first("total").alias("c"))
    rest, rest_parent = (F.greatest(1 - F.col(x), F.lit(1e-12)) for x in ("p", "parent"))
    good = F.col("c") * (F.col("kl") + rest * F.log(rest / rest_parent)) >= 0.5 * F.col("size") * math.log(max(n, 2))
    states = store(each.where(good).select(F.col("context").alias("key"), "c", F.log10(rest / rest_parent).alias("weight")))
    gain = F.log10(F.col("p") / F.col("root"))
    level = level.join(states.select(F.col("key").alias("context"), F.col("weight").alias("skip")), "context", "left")
    return store(level.select("key", "suffix", "c", F.when(F.col("skip").isNotNull(), gain).otherwise(F.col("v")).alias("ratio"), (gain - F.col("skip") - F.col("v")).alias("weight"))), states


_SCORED = "id long, at long, doc_id long, n_tokens long, base double, known long, adjust double, part long, word boolean, keys binary, texts binary"
_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def _scores(depth: int, bits: int, unseen: float, words_var, strings_var, any_var):
    """A row for each text with what the held part says of it, and blocks of the words and strings that have to be joined.

    Texts are numbered within groups; a block has the sorted keys of a group in one range, and each key's text.
    Words that aren't held count as unseen here.
    """

    def run(batches):
        words, strings, any_of = words_var.value, strings_var.value, any_var.value
        group, texts, many = TaskContext.get().partitionId() << 32, 0, 0
        asked: dict[bool, list[np.ndarray]] = {True: [], False: []}

        def blocks():
            rows = []
            for is_word, held in asked.items():
                key, text = np.concatenate(held, axis=1) if held else np.empty((2, 0), _U)
                order = np.argsort(key)
                key, text = key[order], text[order].astype(np.uint16)
                rows += [(p, is_word, encode(key[lo:hi]), text[lo:hi].tobytes()) for p, lo, hi in pieces((key >> _U(64 - bits)).astype(np.int64))]
                held.clear()
            n = len(rows)
            none, no_float = pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())
            part, is_word, key, text = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array([group] * n, pa.int64()), none, none, none, no_float, none, no_float, pa.array(part, pa.int64()), pa.array(is_word, pa.bool_()), pa.array(key, pa.binary()), pa.array(text, pa.binary())], _NAMES)

        for batch in batches:
            for lo, hi, data, bounds in chunks(batch.column(1)):
                docs = hi - lo
                token, doc = _tokens(data, bounds)
                if texts and (texts + docs > GROUP_TEXTS or many + len(token) > GROUP_WORDS):
                    yield blocks()
                    group, texts, many = group + 1, 0, 0
                at, found = words.find(token)
                rare = ~found
                missing = np.bincount(doc[rare], minlength=docs)
                base = np.bincount(doc[found], words.values[at[found]], docs) + unseen * missing
                asked[True].append(np.stack([token[rare], (doc[rare] + texts).astype(_U)]))
                adjust = np.zeros(docs)
                ends, place = _endings(token, doc, depth + 1)
                for k, end in enumerate(ends):
                    inside = np.flatnonzero(any_of.test(end) & (place >= k))
                    at, found = strings.find(end[inside])
                    adjust += np.bincount(doc[inside[found]], strings.values[at[found]], docs)
                    rest = inside[~found]
                    asked[False].append(np.stack([end[rest], (doc[rest] + texts).astype(_U)]))
                size = np.bincount(doc, minlength=docs)
                none = pa.nulls(docs, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(docs, group)), pa.array(np.arange(texts, texts + docs)), batch.column(0).slice(lo, docs), pa.array(size), pa.array(base), pa.array(size - missing), pa.array(adjust), pa.nulls(docs, pa.int64()), pa.nulls(docs, pa.bool_()), none, none], _NAMES)
                texts, many = texts + docs, many + len(token)
        yield blocks()

    return run


def _answers(key, asked, model):
    """What the words and strings of one range add to the texts of each group that asks for them."""
    order = np.argsort(model.column("key").to_numpy().view(_U))
    keys = model.column("key").to_numpy().view(_U)[order]
    more, seen, weight = (model.column(c).to_numpy()[order] for c in ("more", "seen", "weight"))
    rows = []
    for group, is_word, block, of in zip(*(asked.column(c) for c in ("id", "word", "keys", "texts")), strict=True):
        want, text = decode(block.as_buffer()), np.frombuffer(of.as_buffer(), np.uint16).astype(np.int64)
        at = np.searchsorted(keys, want)
        found = at < len(keys)
        found[found] = keys[at[found]] == want[found]
        at, text = at[found], text[found]
        if not len(at):
            continue
        hit = np.flatnonzero(np.bincount(text))
        is_word = is_word.as_py()
        base, shift = (np.bincount(text, x[at])[hit] if use else np.zeros(len(hit)) for x, use in ((more, is_word), (weight, not is_word)))
        known = np.bincount(text, seen[at])[hit] if is_word else np.zeros(len(hit))
        rows.append((group.as_py(), hit.astype(np.uint16).tobytes(), np.stack([base, known, shift]).tobytes()))
    group, hit, sums = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"id": pa.array(group, pa.int64()), "texts": pa.array(hit, pa.binary()), "sums": pa.array(sums, pa.binary())})


def _summed(key, table, answers):
    """The texts of a group with all answers added."""
    total = np.zeros((3, GROUP_TEXTS))
    # in a fixed order, so that sums of floats agree between runs
    for hit, sums in sorted(zip(answers.column("texts").to_pylist(), answers.column("sums").to_pylist(), strict=True)):
        total[:, np.frombuffer(hit, np.uint16)] += np.frombuffer(sums).reshape(3, -1)
    at = table.column("at").to_numpy()
    base, known, adjust = (table.column(c).to_numpy() for c in ("base", "known", "adjust"))
    base = base + total[0][at]
    return pa.table({"doc_id": table.column("doc_id"), "n_tokens": table.column("n_tokens"), "n_known": known + total[1][at].astype(np.int64), "base_score": base, "score": base + adjust + total[2][at]})


def _filter(df: DataFrame, column: str) -> Bloom:
    return bloom(df, column, df.count())


def tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, options: TreeOptions = TreeOptions()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Words are hashed to 64 bits. Counts are of all training texts, those whose
    crc32(id as text) mod folds is not 0. Level by level, strings of one more word
    are counted where filters of a fixed size at most say that both shorter strings
    may be frequent; those with the least count stay, as tables that grow with the
    corpus. A word's probability is
    that of the longest retained context before it in the text; the base is the root,
    which also gives words never seen their share. The most common words' counts
    and strings' weights are held by all tasks (HELD_COUNT and HELD_STRING_COUNT at least, HELD_WORDS and
    HELD_STRINGS at most); rarer words and strings of a text are joined with theirs and summed.

    Null and empty texts have the end as their only token; texts of any length are taken whole.
    Null ids are held out never and learned from. Repeated rows are learned from each time and each get
    a row. Extra columns are ignored. With no training token base_score uses N = V = 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    training = rows.where(~held_out).select("text")
    share, bits = spark.sparkContext.broadcast, range_bits(rows)
    words = store(key_counts(training, _words, bits))
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"], size["v"]
    den = n + 0.1 * (v + 1)
    common = max(HELD_COUNT, least_count(words, HELD_WORDS))
    token, c = columns(words.where(F.col("c") >= common), "key", "c")
    held_words = share(Held(token, np.log10((c + 0.1) / den)))
    frequent = words.where(F.col("c") >= options.least).select(F.col("key").alias("token"), "c")
    before, shorter, tree = frequent.select(F.col("token").alias("key"), "c", F.lit(0).cast("long").alias("suffix")), None, []
    for k in range(options.depth):
        counted = _counted(training, k + 1, bits, held_words, share(_filter(before, "key")), options.least)
        level = counted.join(before.select(F.col("key").alias("context"), F.col("c").alias("total"), F.col("suffix").alias("shorter")), "context").withColumn("one", F.lit(k == 0))
        level = store(level.mapInArrow(_suffixed, "context long, token long, c long, total long, key long, suffix long"))
        shorter, states = grow(frequent, level, shorter, den, n, options)
        discard(level)
        tree += [shorter.where("weight is not null").select("key", "c", "weight"), states]
        before = shorter
    strings = functools.reduce(DataFrame.unionAll, tree, spark.createDataFrame([], "key long, c long, weight double"))
    strings = store(strings.groupBy("key").agg(F.max("c").alias("c"), F.sum("weight").alias("weight")))

    often = max(HELD_STRING_COUNT, least_count(strings, HELD_STRINGS))
    held_strings = share(Held(*columns(strings.where(F.col("c") >= often), "key", "weight")))
    unseen = math.log10(0.1 / den)
    scored = store(rows.mapInArrow(_scores(options.depth, bits, unseen, held_words, held_strings, share(_filter(strings, "key"))), _SCORED))
    part = F.shiftrightunsigned("key", 64 - bits).alias("part")
    zero: Column = F.lit(0.0)
    model = words.where(F.col("c") < common).select("key", part, (F.log10((F.col("c") + 0.1) / F.lit(den)) - F.lit(unseen)).alias("more"), F.lit(1.0).alias("seen"), zero.alias("weight"))
    model = model.unionAll(strings.where(F.col("c") < often).select("key", part, zero, zero, "weight")).groupBy("key", "part").agg(*(F.sum(x).alias(x) for x in ("more", "seen", "weight")))
    asked = scored.where("part is not null").select("part", "id", "word", "keys", "texts")
    answers = asked.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(_answers, "id long, texts binary, sums binary")
    whole = scored.where("at is not null").select("id", "at", "doc_id", "n_tokens", "base", "known", "adjust")
    out = whole.groupBy("id").cogroup(answers.groupBy("id")).applyInArrow(_summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
