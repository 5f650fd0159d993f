"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._keys import Held, columns, key_counts, least_count, range_bits
from ._spark import bloom, discard, settle, store
from ._text import chunks, mix, shingle_sets
from .components import connected_components

_U = np.uint64
#: Common tokens whose counts every task holds, at most; beyond that the least common of them count as rare.
HELD_TOKENS = 1 << 22
#: Leading bits of a token by which it is counted; tokens that share them rank alike.
CODE_BITS = 40
_CODE = _U(((1 << CODE_BITS) - 1) << (64 - CODE_BITS))
#: Sets in a block of a component whose links are counted; each pair of blocks is a task's group.
BLOCK = 128


@dataclass(frozen=True)
class JaccardOptions:
    """width: words of a shingle; threshold: least similarity, as a fraction;
    common: documents from which a token counts as common and stands behind rarer ones;
    crowded: documents from which a token's list is split into ``salts`` parts."""

    width: int = 5
    threshold: Fraction = Fraction(3, 4)
    common: int = 16
    crowded: int = 4096
    salts: int = 64


def _class_of(tokens: np.ndarray) -> int:
    """A number that stands for a whole set."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        x = mix(tokens).sum(dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mix(tokens + _U(0x632BE59BD9B4E019)))
        return int(mix(np.array([x + _U(len(tokens))]))[0].astype(np.int64))


def _parity(tokens: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of tokens falls to b; two to four bits a token, in a power of two."""
    bits = 64 << max(0, (2 * len(tokens) - 1).bit_length() - 6)
    odd = np.bincount(((tokens >> _U(8)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _odd_bits(x: bytes, y: bytes) -> int:
    """In how many bits two parity sketches differ, the longer folded to the shorter: no more than their sets in tokens."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        half = len(b) // 2
        b = b[:half] ^ b[half:]
    return int(np.bitwise_count(a ^ b).sum())


def _overview(options: JaccardOptions):
    """Each document's size, class and parity sketch."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in chunks(batch.column(2)):
                sizes, classes, parity = [], [], []
                for tokens in shingle_sets(data, bounds, options.width):
                    sizes.append(len(tokens))
                    classes.append(_class_of(tokens))
                    parity.append(_parity(tokens))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(parity, pa.binary())], ["doc_id", "row_key", "n", "class", "parity"])

    return run


def _codes(options: JaccardOptions):
    def run(batch):
        for _, _, data, bounds in chunks(batch.column(0)):
            yield np.concatenate(list(shingle_sets(data, bounds, options.width))) >> _U(64 - CODE_BITS)

    return run


def _common_tokens(texts: DataFrame, options: JaccardOptions) -> Held:
    """How many documents hold each common token, by its leading bits."""
    counted = store(key_counts(texts, _codes(options), range_bits(texts), CODE_BITS, options.common))
    code, count = columns(counted.where(F.col("c") >= least_count(counted, HELD_TOKENS)), "key", "c")
    return Held(code << _U(64 - CODE_BITS), count)


def _matches(others: np.ndarray, short: int) -> int:
    """How many shared tokens to ask for: the power of two whose prefix costs least.

    others has, for each token in prefix order, how many other documents hold it, as
    far as it is common. A prefix for l shared tokens has l - 1 tokens more; it
    costs its own rows, a row for each of its tokens' other documents, and for each
    partner the comparison of two sketches. Common tokens mostly come in whole passages, so
    the partners that share l of them are taken to be as many as the l-th most common has.
    """
    if not others[:short].any():
        return 1
    n, best, least = len(others), 1, math.inf
    for l in (1 << i for i in range((n - short + 1).bit_length())):
        prefix = others[: short + l - 1]
        partners = np.partition(prefix, -l)[-l]
        if (cost := len(prefix) + prefix.sum() + partners * (10 + n / 32)) < least:
            best, least = l, cost
        if not partners:
            break
    return best


def _prefixes(options: JaccardOptions, held):
    """A row for each token of a class's prefix: rare tokens first, then by hash. A task shows a class once."""
    num, den = options.threshold.numerator, options.threshold.denominator
    names = ["token", "class", "n", "match", "salt", "outer", "pos"]

    def run(batches):
        common, done = held.value, set()
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                out = []
                for tokens in shingle_sets(data, bounds, options.width):
                    n = len(tokens)
                    if not n or (cls := _class_of(tokens)) in done:
                        continue
                    done.add(cls)
                    at, found = common.find(tokens & _CODE)
                    count, short = np.ones(n), n - -(-n * num // den) + 1
                    match = 1
                    if found.any():
                        count[found] = common.values[at[found]]
                        order = np.argsort(np.where(found, np.floor(np.log2(count)), 0), kind="stable")
                        tokens, count, found = tokens[order], count[order], found[order]
                        match = _matches(np.where(found, count - 1, 0), short)
                    p = short + match - 1
                    salt = np.where(count[:p] >= options.crowded, cls % options.salts + 1, 0)
                    # the mean count of its tokens is highest for the text that most others are copies of
                    out.append((tokens[:p], salt, cls, n, match, -int(min(count.mean() * 16, 2**31 - 1)), np.arange(p, dtype=np.int32)))
                if out:
                    each = [len(x[0]) for x in out]

                    def spread(i, kind, out=out, each=each):
                        return pa.array(np.repeat(np.array([x[i] for x in out], kind), each))

                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), spread(2, np.int64), spread(3, np.int32), spread(4, np.int32), pa.array(np.concatenate([x[1] for x in out]).astype(np.int32)), spread(5, np.int32), pa.array(np.concatenate([x[6] for x in out]))], names)

    return run


def _close(options: JaccardOptions):
    """Keeps the pairs whose parity sketches differ in no more bits than linked sets may in tokens."""
    num, den = options.threshold.numerator, options.threshold.denominator

    def run(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            most = n + m - 2 * -(-(n + m) * num // (num + den))
            good = [_odd_bits(x.as_buffer(), y.as_buffer()) <= k for x, y, k in zip(batch.column("s"), batch.column("t"), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _whole_sets(options: JaccardOptions, wanted):
    """The sorted tokens of the classes that may be wanted, once in a task."""

    def run(batches):
        keep, done = wanted.value, set()
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                found = [(_class_of(t), t) for t in shingle_sets(data, bounds, options.width) if len(t)]
                ok = keep.test(np.array([c for c, _ in found], np.int64))
                kept = {c: t for (c, t), good in zip(found, ok, strict=True) if good and c not in done}
                done.update(kept)
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array([t.tobytes() for t in kept.values()], pa.binary())], ["class", "tokens"])

    return run


def _verify(options: JaccardOptions):
    num, den = options.threshold.numerator, options.threshold.denominator

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum())
                good.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _block_links(options: JaccardOptions):
    num, den = options.threshold.numerator, options.threshold.denominator

    def run(key, group):
        """The links between two blocks, or inside one, as counts of each class."""
        left = group.column("left").to_numpy()
        own, sets = group.column("class").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("tokens").combine_chunks()]
        inside, count = key[1] == key[2], np.zeros(len(own), np.int64)
        for a in np.flatnonzero(left):
            others = np.arange(a + 1, len(own)) if inside else np.flatnonzero(~left)
            for b in others:
                s, t = sorted((sets[a], sets[b]), key=len)
                if len(s) * den < num * len(t):
                    continue
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum())
                if den * both >= num * (len(s) + len(t) - both):
                    count[a] += 1
                    count[b] += 1
        return pa.table({"class": own, "n_links": count})

    return run


def _link_counts(docs: DataFrame, roots: DataFrame, options: JaccardOptions) -> DataFrame:
    """(class, n_links): every pair of a component is verified, block by block, as links never leave it."""
    # a root has no row of its own
    wanted = settle(roots.select("class", "root").unionAll(roots.select(F.col("root").alias("class"), "root")).distinct())
    keep = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "class", wanted.count()))
    sets = docs.select("text").mapInArrow(_whole_sets(options, keep), "class long, tokens binary").groupBy("class").agg(F.first("tokens").alias("tokens"))
    many = wanted.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = wanted.join(many, "root").withColumn("block", F.pmod(F.xxhash64("class", F.lit(11)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = placed.select("class", "root", "block", other.alias("other"))
    pairs = pairs.select("class", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"))
    counted = pairs.join(sets, "class").select("root", "i", "j", "left", "class", "tokens").groupBy("root", "i", "j").applyInArrow(_block_links(options), "class long, n_links long")
    return counted.groupBy("class").agg(F.sum("n_links").alias("n_links"))


def _groups(docs: DataFrame, options: JaccardOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, row_key, text): (doc_id, row_key, n, class) of all rows, (class, root) of all
    classes that are no roots, and (class, least), the smallest id, of all classes."""
    spark, texts = docs.sparkSession, docs.select("text")
    each = store(docs.mapInArrow(_overview(options), "doc_id long, row_key long, n long, class long, parity binary"))
    classes = store(each.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity")))
    held = spark.sparkContext.broadcast(_common_tokens(texts, options))

    salted = texts.mapInArrow(_prefixes(options, held), "token long, class long, n int, match int, salt int, outer int, pos int")
    group = Window.partitionBy("token", "salt")
    of_token = group.orderBy("outer", "class")
    row = ("outer", "class", "n", "match", "pos")
    # a task shows a class once, other tasks may show it again; of each list the first row of a class stays
    listed = salted.withColumn("prev", F.lag("class").over(of_token)).withColumn("k", F.count("*").over(group)).withColumn("p", F.first(F.struct(*row)).over(of_token))
    listed = store(listed.where("(prev is null or prev != class) and (salt > 0 or k > 1)").select("token", *row, "salt", "k", "p"))

    num, den = options.threshold.numerator, options.threshold.denominator

    def may_link(x, y, longer=F.lit(True)):
        """Whether a token shared by two rows stands in the prefixes that this pair's sizes (and matches, if longer) ask for."""
        overlap = F.floor((num * (x("n") + y("n")) + num + den - 1) / (num + den))
        more = F.when(longer, F.least(x("match"), y("match")) - 1).otherwise(0)
        inside = [side("pos") <= side("n") - overlap + more for side in (x, y)]
        return (F.least(x("n"), y("n")) * den >= F.greatest(x("n"), y("n")) * num) & inside[0] & inside[1]

    # a crowded token's list was split, so its parts' first classes are put together
    crowded = listed.where("salt > 0")
    heads = crowded.groupBy("token").agg(F.min("p").alias("p"))
    crowded = crowded.drop("p").join(heads, "token").select("token", *row, F.lit(3).cast("long").alias("k"), "p")
    starred = listed.where("salt = 0").select("token", *row, "k", "p").unionAll(crowded)
    # lists of two are settled here, the others' first trials may be fewer
    starred = starred.where(F.col("class") != F.col("p.class")).where(may_link(F.col, lambda c: F.col(f"p.{c}"), F.col("k") == 2))
    pairs = settle(starred.select(F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b")).distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = classes.select(F.col("class").alias("a"), "n", F.col("parity").alias("s")), classes.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("parity").alias("t"))
        near = settle(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "s", "t").mapInArrow(_close(options), "a long, b long"))
        wanted = settle(near.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        keep = spark.sparkContext.broadcast(bloom(wanted, "class", wanted.count()))
        sets = texts.mapInArrow(_whole_sets(options, keep), "class long, tokens binary")
        sets = sets.groupBy("class").agg(F.first("tokens").alias("tokens"))
        x, y = sets.select(F.col("class").alias("a"), F.col("tokens").alias("s")), sets.select(F.col("class").alias("b"), F.col("tokens").alias("t"))
        return settle(near.join(x, "a").join(y, "b").select("a", "b", "s", "t").mapInArrow(_verify(options), "a long, b long"))

    links = verified(pairs)
    roots = connected_components(links)

    # second round: classes that share enough prefix tokens and are still apart; lists of two were settled by the first
    open_lists = listed.where("salt > 0 or k > 2").select("token", "class", "n", "match", "pos")
    placed = open_lists.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    apart = store(placed.join(mixed, "token"))
    x, y = (apart.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "match", "pos", "root"))) for s in "xy")
    near = may_link(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"))
    tried = x.join(y, (x["token"] == y["token"]) & (F.col("class_x") < F.col("class_y")) & (F.col("root_x") != F.col("root_y")) & near)
    again = tried.groupBy(F.col("class_x").alias("a"), F.col("class_y").alias("b")).agg(F.count("*").alias("k"), F.min(F.least("match_x", "match_y")).alias("need"))
    pairs = settle(again.where("k >= need").select("a", "b").join(pairs, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        links = settle(links.unionAll(verified(pairs)).distinct())
        roots = connected_components(links)
    discard(listed, apart)
    return each.select("doc_id", "row_key", "n", "class"), roots.withColumnRenamed("node", "class"), classes.select("class", "least")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JaccardOptions = JaccardOptions(), count_links: bool = True) -> DataFrame:
    """One row per document: id, n_shingles, component_id, class_id, n_links.

    Two documents are linked when the Jaccard similarity of their sets of word
    shingles reaches the threshold; component_id is the smallest id that links
    reach. n_links counts the other different sets linked to the document's set (0 also
    where all its links are exact copies), by verifying all pairs of a component in
    blocks, which takes time with the square of a component's different sets. Without
    count_links the column is left out.

    Equal sets make one class, and only classes are joined. Tokens stand in a
    global order: rare ones first, common ones by their exact counts over all documents,
    ties by hash. A document's prefix holds its first n - ceil(t n) + l tokens; l is
    chosen for each document by the estimated cost of the rows and comparisons that
    its prefix leads to. A pair is verified only if
    it shares as many tokens as the smaller l of the two, all within the first
    n - a + l of either, a being the overlap that their two sizes ask for, and if their
    parity sketches differ in no more bits than linked sets may in tokens. Each
    token's documents are first tried against the one whose tokens are the most
    common on the whole, the likely origin of copies; pairs of classes that are then
    still in different components are tried in a second round, so no link between
    components is lost, and a group of near copies costs a trial per member.

    Null and blank texts have the empty set, link with nothing, and are their own
    component. Fewer words than ``width`` make one shingle. Texts of any length are
    taken whole; a task holds one document's set at a time. Repeated rows of an id
    each get a row. Null ids get a row with a null component unless they are linked.
    Extra columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_key"), F.col(text_col).cast("string").alias("text"))
    each, roots, classes = _groups(docs, options)
    classes = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    low = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = classes.join(low, "root").select("class", "component_id")
    alone = each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("class").alias("class_id"))
    full = each.where("n > 0").join(of_class, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("class").alias("class_id"))
    out = full.unionAll(alone)
    if not count_links:
        return out
    counts = _link_counts(docs, roots, options).withColumnRenamed("class", "class_id")
    return out.join(counts, "class_id", "left").select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JaccardOptions = JaccardOptions()) -> DataFrame:
    """One row of each group of documents that are linked, directly or by way of others: the one of the smallest id.

    Decided row by row: of rows with the same id the least hash of id and text stays, null ids
    come last, and of rows that agree in id and text one stays, with any of their other
    columns. Texts without words are in no group and all stay. All columns are kept, whatever their names.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("row_key"), F.col(text_col).cast("string").alias("text"))
    each, roots, _ = _groups(rows, options)
    placed = each.where("n > 0").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    by_row = placed.groupBy("root", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = by_row.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first"))
    marks = by_row.join(first, "root").withColumn("stays", F.col("row_key") == F.col("first.row_key")).where("not stays or n > 1")
    marks = settle(marks.select(F.col("row_key").alias("k"), "stays").distinct())
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), key.alias("k"))
    kept = packed.join(marks.select("k"), "k", "left_anti").select("row.*")
    repeated = marks.where("stays").select("k")
    if repeated.isEmpty():
        return kept
    once = packed.join(repeated, "k").withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("k"))).where("i = 1")
    return kept.unionAll(once.select("row.*"))
